"""Constants of the analysis, held as plain values so a caller can pass other ones."""

from __future__ import annotations

from pyspark.sql import types as T

# --- Fixed values: travel-time bands -------------------------------------------------
# (exclusive upper bound in hours, band code); hours at or above the last bound get 0.
BAND_BREAKS = [
    (0.0, 0),
    (0.501, 1),
    (1.01, 2),
    (2.01, 3),
    (4.01, 4),
    (8.01, 5),
    (16.01, 6),
    (32.01, 7),
    (100.0, 8),
]
BAND_DEFAULT = 0

# --- Fixed values: band labels, in band order 1..8 -----------------------------------
BAND_LABELS = {
    1: "0 to 30 minutes",
    2: "30 minutes to 1 hour",
    3: "1 to 2 hours",
    4: "2 to 4 hours",
    5: "4 to 8 hours",
    6: "8 to 16 hours",
    7: "16 to 32 hours",
    8: "> 32 hours",
}

# --- Fixed values: band colours, in band order 1..8 ----------------------------------
BAND_COLOURS = {
    1: "darkgreen",
    2: "#2ab72e",
    3: "lightgreen",
    4: "#e3eb96",
    5: "#f4f007",
    6: "#FECC42",
    7: "#f96a34",
    8: "red",
}

# --- Fixed values: facility codes and names ------------------------------------------
FACILITY_NAMES = {
    "allhf": "All health facilities",
    "allhosp": "All hospitals",
    "dhq": "District Headquarters",
    "privhosp": "Private hospitals",
    "govhosp": "Government hospitals",
    "hps": "Health posts and sub-health posts",
    "banks": "Commercial and development banks",
    "fi": "All financial institutions",
}

# --- Fixed values: season codes and names --------------------------------------------
SEASON_NAMES = {
    "MSN": "Monsoon season",
    "MSNW": "Monsoon season (walking only)",
    "NM": "Normal times",
    "NMW": "Normal times (walking only)",
}
NORMAL = "Normal times"
MONSOON = "Monsoon season"
NON_WALKING = [NORMAL, MONSOON]

# --- Fixed values: physiographic zones in display order ------------------------------
ZONE_ORDER = ["Terai", "Shivalik", "Hill", "Mountain", "High Mountain"]

# --- Fixed values: code layout -------------------------------------------------------
ADM2_CODE_LENGTH = 14  # local government code, the province digit sits at position 5
PROVINCE_POSITION = 5
ADM1_CODE_LENGTH = 1
SRID = 32644

# Width of a column strip: the join key of cells and spans, and the length of a row segment.
STRIP = 256

LGU_RESULT = T.StructType(
    [
        T.StructField("adm_name", T.StringType()),
        T.StructField("adm2_code", T.StringType()),
        T.StructField("province", T.StringType()),
        T.StructField("trav_value", T.IntegerType()),
        T.StructField("trav_cat", T.StringType()),
        T.StructField("adm_pop", T.DoubleType()),
        T.StructField("cat_pop", T.DoubleType()),
        T.StructField("pc_pop", T.DoubleType()),
    ]
)

PROVINCE_RESULT = T.StructType(
    [
        T.StructField("adm_name", T.StringType()),
        T.StructField("adm_code", T.StringType()),
        T.StructField("trav_value", T.IntegerType()),
        T.StructField("trav_cat", T.StringType()),
        T.StructField("adm_pop", T.DoubleType()),
        T.StructField("cat_pop", T.DoubleType()),
        T.StructField("pc_pop", T.DoubleType()),
    ]
)

ZONE_LOOKUP = T.StructType(
    [T.StructField("adm2_code", T.StringType()), T.StructField("geog", T.StringType())]
)
