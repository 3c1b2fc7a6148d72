"""Zonal sums from running sums: a span costs two look-ups, whatever its length, and no cell is unfolded.

The raster is kept as row segments that hold, at every place, sum and count of the row's values up to there. The sum of a
span is the entry at its end less the one before its start. Spans are outlines, so the work of a zonal sum grows with
outlines, and many layers of zones (one per catchment file, say) share one table of running sums.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from access_engine.config import STRIP
from access_engine.operators.grid import Grid, strip_of

# the summing function travels with the job, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _accumulated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums and counts within each segment, up to and with every place; a missing value adds nothing."""
    for batch in batches:
        values = batch.column("value")
        flat = values.flatten()
        known = flat.is_valid().to_numpy(zero_copy_only=False)
        numbers = np.where(known, flat.to_numpy(zero_copy_only=False), 0.0).astype(float)
        if not np.isfinite(numbers).all():
            raise ValueError("running sums need finite values; a place without one is NULL")
        sizes = np.asarray(pa.compute.list_value_length(values).fill_null(0))
        # each segment is summed by itself, so a long table does not add to the rounding of a short row
        wide = int(sizes.max(initial=0))
        place = np.arange(wide) < sizes[:, None]
        block, count = np.zeros(place.shape), np.zeros(place.shape, np.int64)
        block[place], count[place] = numbers, known
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        sums = pa.ListArray.from_arrays(offsets, pa.array(np.cumsum(block, 1)[place]))
        counts = pa.ListArray.from_arrays(offsets, pa.array(np.cumsum(count, 1)[place]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("row_no"), batch.column("strip"), sums, counts], ["row_no", "strip", "sums", "counts"]
        )


def running_sums(segments: DataFrame, value: str, grid: Grid, width: int = STRIP) -> DataFrame:
    """Row segments -> ``row_no, strip, sum_before, count_before, sums, counts``.

    ``sums`` and ``counts`` run within a segment; what the row holds left of it is ``sum_before`` and ``count_before``. A
    strip that the raster leaves out to the right of a segment gets a row of its own with what lies before it. Values are
    finite or NULL. The window holds one raster row in segments.
    """
    rows = segments.select("row_no", "strip", F.col(value).cast("array<double>").alias("value"))
    inside = rows.mapInArrow(_accumulated, "row_no int, strip int, sums array<double>, counts array<long>")
    along = Window.partitionBy("row_no").orderBy("strip")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    last_strip = (grid.ncols - 1) // width
    none = F.lit(0)
    total, many = F.coalesce(F.element_at("sums", -1), F.lit(0.0)), F.coalesce(F.element_at("counts", -1), none)
    filled = inside.select(
        "*",
        F.coalesce(F.sum(total).over(before), F.lit(0.0)).alias("sum_before"),
        F.coalesce(F.sum(many).over(before), none).alias("count_before"),
        F.coalesce(F.lead("strip").over(along), F.lit(last_strip + 1)).alias("until"),
    )
    every = filled.withColumn("at", F.explode(F.sequence("strip", F.greatest("strip", F.col("until") - 1))))
    own = F.col("at") == F.col("strip")
    return every.select(
        "row_no",
        F.col("at").alias("strip"),
        F.when(own, F.col("sum_before")).otherwise(F.col("sum_before") + total).alias("sum_before"),
        F.when(own, F.col("count_before")).otherwise(F.col("count_before") + many).alias("count_before"),
        F.when(own, F.col("sums")).alias("sums"),
        F.when(own, F.col("counts")).alias("counts"),
    )


def span_sums(
    spans: DataFrame, running: DataFrame, keys: Sequence[str], prefix: str = "pop_", width: int = STRIP
) -> DataFrame:
    """Sum and count of the raster's values under all spans of a key: ``keys, <prefix>sum, <prefix>count``.

    A key none of whose cells has a value has the sum NULL and the count 0.
    """
    end = F.inline(
        F.array(
            F.struct((F.col("c1") - 1).alias("place"), F.lit(1).alias("sign")),
            F.struct((F.col("c0") - 1).alias("place"), F.lit(-1).alias("sign")),
        )
    )
    ends = spans.where("c0 < c1").select(*keys, "row_no", end)
    # what two spans of a key have in common cancels before the join
    ends = ends.groupBy(*keys, "row_no", "place").agg(F.sum("sign").alias("sign")).withColumn("strip", strip_of(F.col("place"), width))
    met = ends.join(running, ["row_no", "strip"], "left")
    at = F.col("place") - F.col("strip") * width
    upto = F.coalesce(F.col("sum_before") + F.coalesce(F.get("sums", at), F.lit(0.0)), F.lit(0.0))
    many = F.coalesce(F.col("count_before") + F.coalesce(F.get("counts", at), F.lit(0)), F.lit(0))
    sums = met.groupBy(*keys).agg(
        F.sum(F.col("sign") * upto).alias("sum"), F.sum(F.col("sign") * many).alias("count")
    )
    return sums.select(
        *keys, F.when(F.col("count") > 0, F.col("sum")).alias(f"{prefix}sum"), F.col("count").alias(f"{prefix}count")
    )
