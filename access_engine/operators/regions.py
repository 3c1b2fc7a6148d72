"""Connected areas of equal class (4-neighbourhood), for rasters of any size, on runs of cells.

What is moved are runs of equal class along raster rows, cut at column strips. Runs are united inside tiles first, each a
bounded group; only pairs of labels that touch across a tile border enter the distributed contraction. What iterates is
therefore a small fraction of the runs, and a component that fills the raster costs a few rounds over tile borders.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from access_engine.operators.boundary import cells_to_spans
from access_engine.operators.grid import Grid, tasks_of
from access_engine.operators.spans import burn, cut_by_strip
from access_engine.storage import drop, store

TILE = 128
BLOCK = 1 << 18  # runs that a task unites at once; a tile's may be more
SALT = 8  # tasks that share the edges of one node

# the tile function travels with the job, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _united(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of the component of each of ``n`` nodes that the links ``a, b`` make."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        high = np.maximum(label[a], label[b])
        moved = low < high
        if not moved.any():
            return label
        np.minimum.at(label, high[moved], low[moved])
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up


def _label_runs(pdf: pd.DataFrame, group: np.ndarray, ncols: int) -> np.ndarray:
    """Smallest cell id of each run's component within its tile; runs are sorted by tile, row and column.

    Below a run lie those of the next row that end after its start and start before its end: one range of the sorted
    runs of the tile, as they don't overlap.
    """
    row, c0, c1 = (pdf[c].to_numpy(np.int64) for c in ("row_no", "c0", "c1"))
    wide = ncols + 1
    line = group * (int(row.max(initial=0)) + 2) + row
    first = np.searchsorted(line * wide + c1, (line + 1) * wide + c0, "right")
    last = np.maximum(np.searchsorted(line * wide + c0, (line + 1) * wide + c1, "left"), first)
    sizes = last - first
    above = np.repeat(np.arange(len(row)), sizes)
    below = np.arange(len(above)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + first[above]
    kind = pd.factorize(pdf["class"].to_numpy())[0]
    same = kind[above] == kind[below]
    return (row * ncols + c0)[_united(len(row), above[same], below[same])]


def _tiles(tile_columns: Sequence[str], ncols: int, block: int):
    """A function for ``mapInPandas`` over runs sorted by tile: adds ``label``; a tile is never parted."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def out(whole: pd.DataFrame, group: np.ndarray) -> pd.DataFrame:
            return whole.assign(label=_label_runs(whole, group, ncols))

        for frame in frames:
            held.append(frame)
            if sum(map(len, held)) < block:
                continue
            whole = pd.concat(held, ignore_index=True)
            group = whole.groupby(list(tile_columns), sort=False, dropna=False).ngroup().to_numpy()
            full = int(np.searchsorted(group, group[-1]))
            if full:
                yield out(whole[:full], group[:full])
            held = [whole[full:]]
        whole = pd.concat(held, ignore_index=True) if held else pd.DataFrame()
        if len(whole):
            group = whole.groupby(list(tile_columns), sort=False, dropna=False).ngroup().to_numpy()
            yield out(whole, group)

    return run


def _salted(rows: DataFrame, by: str) -> DataFrame:
    return rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALT)).cast("int"))


def _on_every_salt(rows: DataFrame) -> DataFrame:
    return rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))


def _star_round(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One large-star and one small-star step on edges ``hi > lo``.

    Minima are aggregated map-side and joined back. The joins are salted by the other end, so the
    many edges of a node that a raster-filling area hangs on go to several tasks; only nodes that
    have something to pass on, few after the first round, are repeated for it. ``moved`` tells
    whether the step changed anything.
    """
    # only a node with a smaller neighbour can move the edges it is the lower end of
    below = edges.groupBy(*keys, "hi").agg(F.min("lo").alias("m")).withColumnRenamed("hi", "lo")
    passing = below.join(edges.select(*keys, "lo").distinct(), [*keys, "lo"], "left_semi")
    large = (
        _salted(edges, "hi")
        .join(_on_every_salt(passing), [*keys, "lo", "salt"], "left")
        .select(
            *keys, "hi", F.coalesce("m", "lo").alias("lo"), F.col("m").isNotNull().alias("moved")
        )
    )
    lowest = large.groupBy(*keys, "hi").agg(
        F.min("lo").alias("m"), F.max("lo").alias("most"), F.max("moved").alias("moved")
    )
    several = lowest.where(F.col("m") < F.col("most")).select(*keys, "hi", "m")
    small = (
        _salted(large.drop("moved"), "lo")
        .join(_on_every_salt(several), [*keys, "hi", "salt"])
        .where(F.col("lo") > F.col("m"))
        .select(
            *keys, F.col("lo").alias("hi"), F.col("m").alias("lo"), F.lit(True).alias("moved")
        )
    )
    roots = lowest.select(*keys, "hi", F.col("m").alias("lo"), "moved")
    return small.unionAll(roots).groupBy(*keys, "hi", "lo").agg(F.max("moved").alias("moved"))


def connected_components(pairs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``a, b`` pairs of node ids -> ``node, component`` with the smallest id as component.

    Nodes of different ``keys`` are different nodes. Every node of a pair gets a row, except the
    smallest of its component. Each round is written to the shared folder and older ones
    are removed, so the plan stays short and a lost executor costs one round at most.
    """
    spark = pairs.sparkSession
    edges, path = store(
        pairs.where(F.col("a") != F.col("b"))
        .select(*keys, F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
        .distinct(),
        "links",
    )
    superseded = None
    while True:
        following, next_path = store(_star_round(edges, keys), "links")
        # a round is removed one round late: stages the optimizer gave up may still be reading it
        if superseded:
            drop(spark, superseded)
        edges, superseded, path = following, path, next_path
        if not edges.agg(F.max("moved")).first()[0]:
            return edges.select(*keys, F.col("hi").alias("node"), F.col("lo").alias("component"))
        edges = edges.drop("moved")


def _across(local: DataFrame, keys: Sequence[str], tile: int) -> DataFrame:
    """Pairs ``a, b`` of labels of one class that touch across a tile border.

    Sideways a run that ends at a border meets the one that starts there; downwards runs of the last row of a tile meet
    those of the first row below that share a column. Both look at the runs along borders only.
    """
    ends = F.array_compact(
        F.array(
            F.when(F.col("c1") % tile == 0, F.struct(F.col("c1").alias("col"), F.lit(True).alias("left"))),
            F.when(F.col("c0") % tile == 0, F.struct(F.col("c0").alias("col"), F.lit(False).alias("left"))),
        )
    )
    beside = (
        local.select(*keys, "class", "label", "row_no", F.inline(ends))
        .groupBy(*keys, "class", "row_no", "col")
        .agg(
            F.max(F.when(F.col("left"), F.col("label"))).alias("a"),
            F.max(F.when(~F.col("left"), F.col("label"))).alias("b"),
        )
        .where("a IS NOT NULL AND b IS NOT NULL")
        .select(*keys, "a", "b")
    )
    upper = local.where(F.col("row_no") % tile == tile - 1).select(
        *keys, "class", "strip", (F.col("row_no") + 1).alias("row_no"), "c0", "c1", F.col("label").alias("a")
    )
    lower = local.where(F.col("row_no") % tile == 0).select(
        *keys, "class", "strip", "row_no", F.col("c0").alias("b0"), F.col("c1").alias("b1"), F.col("label").alias("b")
    )
    over = upper.join(lower, [*keys, "class", "strip", "row_no"]).where("c0 < b1 AND b0 < c1")
    return beside.unionByName(over.select(*keys, "a", "b")).distinct()


def connected_runs(
    runs: DataFrame,
    grid: Grid,
    class_col: str,
    keys: Sequence[str] = (),
    tile: int = TILE,
    block: int = BLOCK,
    layers: int | None = None,
) -> DataFrame:
    """Runs ``row_no, c0, c1`` with ``zone_id``: the smallest cell id of the connected area of equal class they lie in.

    Runs of one dataset (``keys``) don't overlap. They come back cut at every ``tile`` columns. The labelled runs stay
    in the shared folder, because the result reads them. Where the number of datasets is known, ``layers`` tells it, and the
    tasks grow in number with grid and layers.
    """
    cut = cut_by_strip(runs, tile).select(
        *keys,
        F.col(class_col).alias("class"),
        "row_no",
        "strip",
        "c0",
        "c1",
        F.floor(F.col("row_no") / tile).cast("int").alias("tile_row"),
    )
    tiles = [*keys, "tile_row", "strip"]
    dealt = cut.repartition(*tiles) if layers is None else cut.repartition(tasks_of(cut.sparkSession, grid, layers), *tiles)
    sorted_runs = dealt.sortWithinPartitions(*tiles, "row_no", "c0")
    out = cut.withColumn("label", F.lit(0).cast("long")).schema
    local, _ = store(sorted_runs.mapInPandas(_tiles(tiles, grid.ncols, block), out).drop("tile_row"), "tiles")
    joined = connected_components(_across(local, keys, tile), keys)
    zone = F.coalesce("component", "label").alias("zone_id")
    return local.join(joined.withColumnRenamed("node", "label"), [*keys, "label"], "left").select(
        *keys, F.col("class").alias(class_col), "row_no", "c0", "c1", zone
    )


def polygonize(
    cells: DataFrame, grid: Grid, class_col: str, keys: Sequence[str] = (), tile: int = TILE
) -> DataFrame:
    """Number the connected areas of equal class; ``zone_id`` is the area's smallest cell id.

    ``cells`` holds ``row_no, col_no``, the class and the ``keys`` of its dataset. For results that need cells;
    :func:`connected_runs` gives the same as runs.
    """
    runs = cells_to_spans(cells, list(dict.fromkeys([*keys, class_col])))
    found = burn(connected_runs(runs, grid, class_col, keys, tile))
    return found.select(*keys, "row_no", "col_no", class_col, "zone_id")
