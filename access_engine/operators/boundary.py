"""Outlines: edge cancellation on polygon rings and on cell sets."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from access_engine.operators.spans import odd_spans

MOST = 1 << 18  # spans that a task settles at once; those of a key in a block may be more

# the outlining function travels with the job, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def dissolve_edges(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Outer edges of all polygons of a key: an edge two of them share vanishes.

    Edges come out without direction, smaller end first.
    """
    start = F.struct(F.col("x1").alias("x"), F.col("y1").alias("y"))
    end = F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"))
    return (
        edges.groupBy(
            *keys, F.least(start, end).alias("start"), F.greatest(start, end).alias("end")
        )
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") % 2 == 1)
        .select(
            *keys,
            F.col("start.x").alias("x1"),
            F.col("start.y").alias("y1"),
            F.col("end.x").alias("x2"),
            F.col("end.y").alias("y2"),
        )
    )


def cells_to_spans(cells: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Runs of neighbouring cells of a raster row; a cell may occur once per key."""
    along = Window.partitionBy(*keys, "row_no").orderBy("col_no")
    run = F.col("col_no") - F.row_number().over(along)
    return (
        cells.select(*keys, "row_no", "col_no", run.alias("run"))
        .groupBy(*keys, "row_no", "run")
        .agg(F.min("col_no").alias("c0"), (F.max("col_no") + 1).alias("c1"))
        .drop("run")
    )


def _group_numbers(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Number of the group of equal ``keys`` of each row; the rows of a group stand together."""
    new = np.zeros(len(table), bool)
    for key in keys:
        codes = table.column(key).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return np.cumsum(new)


def _odd_pairs(places: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends between places that occur an odd number of times."""
    ordered = np.sort(np.concatenate(places))
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, int)
    odd = ordered[first[np.diff(np.append(first, len(ordered))) % 2 == 1]]
    return odd[::2], odd[1::2]


def _outlined(table: pa.Table, group: np.ndarray, keys: Sequence[str], height: int, border: bool) -> pa.Table:
    """Straight segments of whole groups of spans of one key and block of rows; those that touch the block's border, or the others."""
    row, c0, c1 = (table.column(c).to_numpy().astype(np.int64) for c in ("row_no", "c0", "c1"))
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    group = group - group[0]
    top = (table.column("block").to_numpy().astype(np.int64) * height)[starts]
    low, tall = min(c0.min(), c1.min()), height + 1
    wide, r = max(c0.max(), c1.max()) - low + 1, row - top[group]
    parts = []
    for side in ("h", "v"):
        if side == "h":
            places, along = [(group * tall + at) * wide + c - low for at in (r, r + 1) for c in (c0, c1)], wide
        else:
            places, along = [(group * wide + c - low) * tall + at for at in (r, r + 1) for c in (c0, c1)], tall
        begin, end = _odd_pairs(places)
        of, line = np.divmod(begin // along, tall if side == "h" else wide)
        begin, end = begin % along, end % along
        touches = (line % height == 0) if side == "h" else (begin % height == 0) | (end % height == 0)
        of, line, begin, end = (x[touches == border] for x in (of, line, begin, end))
        down, across = top[of], low
        line, begin, end = (line + down, begin + across, end + across) if side == "h" else (line + across, begin + down, end + down)
        found = {key: table.column(key).take(pa.array(starts[of])) for key in keys}
        sides = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(of), np.int8)), [side]).cast(pa.string())
        parts.append(pa.table(found | {"side": sides, "line": line, "c0": begin, "c1": end}))
    return pa.concat_tables(parts)


def _block_outlines(keys: Sequence[str], height: int, border: bool, most: int):
    """A function for ``mapInArrow`` over spans sorted by block and key; a group is never parted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        many, enough = 0, most
        for batch in batches:
            held.append(batch)
            many += batch.num_rows
            if many < enough:
                continue
            table = pa.Table.from_batches(held)
            group = _group_numbers(table, ["block", *keys])
            full = int(np.searchsorted(group, group[-1]))
            if full:
                yield from _outlined(table[:full], group[:full], keys, height, border).to_batches()
            held = table[full:].to_batches()
            many -= full
            enough = max(most, 2 * many)
        if many:
            table = pa.Table.from_batches(held)
            yield from _outlined(table, _group_numbers(table, ["block", *keys]), keys, height, border).to_batches()

    return run


def span_boundary(spans: DataFrame, keys: Sequence[str], height: int = 128, most: int = MOST) -> DataFrame:
    """Boundary of disjoint spans as maximal straight segments on grid lines.

    ``side`` is ``h`` or ``v``, ``line`` the grid line, ``c0, c1`` the extent along it. A grid line
    between two rows belongs to the boundary where exactly one of the rows has a cell, which is
    the even-odd rule on the span ends of both rows; likewise along a column line.

    Spans are moved once, in blocks of ``height`` rows, and settled there. Only segments that touch the border of a block
    move again: the same rule on their ends cancels what both blocks have and runs columns together.
    """
    kind = "int" if {dict(spans.dtypes)[c] for c in ("row_no", "c0", "c1")} == {"int"} else "long"
    placed = spans.select(*keys, "row_no", "c0", "c1", F.floor(F.col("row_no") / height).alias("block"))
    dealt = placed.repartition(*keys, "block").sortWithinPartitions("block", *keys)
    own = ", ".join(f"`{c}` {dealt.schema[c].dataType.simpleString()}" for c in keys)
    out = f"{own}{', ' if own else ''}side string, line long, c0 long, c1 long"
    inner, outer = (
        dealt.mapInArrow(_block_outlines(list(keys), height, border, most), out).select(
            *keys, "side", *[F.col(c).cast(kind).alias(c) for c in ("line", "c0", "c1")]
        )
        for border in (False, True)
    )
    ends = outer.select(*keys, "side", "line", F.explode(F.array("c0", "c1")).alias("col"))
    return inner.unionByName(odd_spans(ends, [*keys, "side"], "line").select(*inner.columns))


def directed_outline(spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Outline of disjoint spans as edges in grid units with the area to their left.

    Columns ``px, py, qx, qy`` (column and row lines, rows counted downwards). Edges break wherever
    the row above or below changes, so two areas touching at a corner stay apart.
    """
    sweep = Window.partitionBy(*keys, "line").orderBy("col")
    steps = spans.select(
        *keys,
        F.explode(
            F.array(
                *[
                    F.struct(
                        (F.col("row_no") + below).alias("line"),
                        F.col(end).alias("col"),
                        F.lit(step * below).alias("above"),
                        F.lit(step * (1 - below)).alias("under"),
                    )
                    for below in (0, 1)
                    for end, step in (("c0", 1), ("c1", -1))
                ]
            )
        ).alias("s"),
    ).select(*keys, "s.*")
    flat = (
        steps.groupBy(*keys, "line", "col")
        .agg(F.sum("above").alias("above"), F.sum("under").alias("under"))
        .where((F.col("above") != 0) | (F.col("under") != 0))
        .select(
            *keys,
            "line",
            "col",
            F.lead("col").over(sweep).alias("next"),
            F.sum("above").over(sweep).alias("in_above"),
            F.sum("under").over(sweep).alias("in_under"),
        )
        .where(F.col("in_above") != F.col("in_under"))
    )
    west = F.col("in_under") > 0
    horizontal = flat.select(
        *keys,
        F.when(west, F.col("next")).otherwise(F.col("col")).alias("px"),
        F.col("line").alias("py"),
        F.when(west, F.col("col")).otherwise(F.col("next")).alias("qx"),
        F.col("line").alias("qy"),
    )
    left = spans.select(
        *keys,
        F.col("c0").alias("px"),
        F.col("row_no").alias("py"),
        F.col("c0").alias("qx"),
        (F.col("row_no") + 1).alias("qy"),
    )
    right = spans.select(
        *keys,
        F.col("c1").alias("px"),
        (F.col("row_no") + 1).alias("py"),
        F.col("c1").alias("qx"),
        F.col("row_no").alias("qy"),
    )
    return horizontal.unionByName(left).unionByName(right)


def signed_area(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Shoelace sum over directed edges ``x1, y1, x2, y2``; holes count negative."""
    twice = F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")
    return edges.groupBy(*keys).agg((F.sum(twice) / 2).alias("area"))
