"""Vector layers: GeoJSON lines in and out, ring tables, polygon edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_POLYGON = "array<array<array<double>>>"


def write_geojson(
    features: DataFrame,
    path: str,
    properties: Sequence[str],
    srid: int,
    partition_by: Sequence[str] = (),
    mode: str = "errorifexists",
) -> None:
    """One feature per line; ``geometry`` is GeoJSON text, the named columns are properties.

    With ``partition_by`` one folder per group; the features keep these columns as properties.
    """
    line = F.concat(
        F.lit('{"type":"Feature","srid":'),
        F.lit(srid).cast("string"),
        F.lit(',"properties":'),
        F.to_json(F.struct(*properties), {"ignoreNullFields": "false"}),
        F.lit(',"geometry":'),
        F.col("geometry"),
        F.lit("}"),
    )
    lines = features.select(*partition_by, line.alias("value"))
    lines.write.mode(mode).partitionBy(*partition_by).text(path)


def read_geojson(
    spark: SparkSession, path: str | Sequence[str], properties: T.StructType
) -> DataFrame:
    """Features with their properties as columns, ``srid``, ``feature`` and ``coordinates``.

    ``Polygon`` and ``MultiPolygon`` come out alike, as nested MultiPolygon coordinates; any other
    geometry and a line that is no JSON stop the run. ``srid`` is NULL where the file has none.
    ``feature`` tells the features of one reading apart, whatever their attributes.
    """
    schema = T.StructType(
        [
            T.StructField("srid", T.IntegerType()),
            T.StructField("properties", properties),
            T.StructField("geometry", T.StringType()),
        ]
    )
    lines = spark.read.schema(schema).option("mode", "FAILFAST").json(path if isinstance(path, str) else list(path))
    kind = F.get_json_object("geometry", "$.type")
    shape = F.get_json_object("geometry", "$.coordinates")
    strict = {"mode": "FAILFAST"}
    coordinates = (
        F.when(kind == "MultiPolygon", F.from_json(shape, f"array<{_POLYGON}>", strict))
        .when(kind == "Polygon", F.array(F.from_json(shape, _POLYGON, strict)))
        .otherwise(
            F.raise_error(F.concat(F.lit("not a polygon: "), F.coalesce(kind, F.lit("no geometry"))))
        )
    )
    return lines.select(
        "properties.*",
        "srid",
        F.monotonically_increasing_id().alias("feature"),
        coordinates.alias("coordinates"),
    )


def ring_vertices(features: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Nested coordinates -> ring table ``keys, part_no, ring_no, seq, x, y``."""
    parts = features.select(*keys, F.posexplode("coordinates").alias("part_no", "rings"))
    rings = parts.select(*keys, "part_no", F.posexplode("rings").alias("ring_no", "points"))
    points = rings.select(*keys, "part_no", "ring_no", F.posexplode("points").alias("seq", "p"))
    x, y = F.get("p", F.lit(0)).alias("x"), F.get("p", F.lit(1)).alias("y")
    return points.select(*keys, "part_no", "ring_no", "seq", x, y)


def ring_edges(vertices: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Closed rings (first vertex repeated at the end) -> directed edges.

    A vertex is joined with its successor by number, so one very long ring spreads over all
    tasks instead of being ordered in one.
    """
    ring = [*keys, "part_no", "ring_no", "seq"]
    start = vertices.select(*ring, F.col("x").alias("x1"), F.col("y").alias("y1"))
    end = vertices.select(
        *ring[:-1], (F.col("seq") - 1).alias("seq"), F.col("x").alias("x2"), F.col("y").alias("y2")
    )
    return start.join(end, ring)


def feature_edges(features: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Nested coordinates -> directed edges without a join: each ring pairs its own points."""
    parts = features.select(*keys, F.posexplode("coordinates").alias("part_no", "rings"))
    rings = parts.select(*keys, "part_no", F.posexplode("rings").alias("ring_no", "points"))
    steps = F.sequence(F.lit(0), F.size("points") - 2)
    pairs = rings.where(F.size("points") > 1).select(
        *keys, "part_no", "ring_no", "points", F.explode(steps).alias("seq")
    )

    def at(offset: int, axis: int):
        return F.get(F.get("points", F.col("seq") + offset), F.lit(axis))

    return pairs.select(
        *keys,
        "part_no",
        "ring_no",
        "seq",
        at(0, 0).alias("x1"),
        at(0, 1).alias("y1"),
        at(1, 0).alias("x2"),
        at(1, 1).alias("y2"),
    )
