"""Rings of an outline by list ranking: a feature of any size is chained by many tasks.

Straight runs are contracted to their corners first. A corner knows the next one on its ring, so an outline is a set of
linked lists that close. Tasks follow the links among the corners they hold, of any feature, to chains; what is left to
rank are the chains, which pointer jumping does in joins on unique keys, twice the distance in every round. Holes find
the ring around them in a sweep along one raster row. Only the text of a geometry is put together in one place.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from access_engine.operators.boundary import directed_outline
from access_engine.operators.grid import Grid
from access_engine.storage import drop, store, stored

# the chaining function travels with the job, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Corners that a task chains at once, and the side of the squares that are kept together for that.
BLOCK = 1 << 18
SQUARE = 512
#: Corners whose coordinates become one piece of text before a ring's pieces meet.
PIECE = 2048

EAST, NORTH, WEST, SOUTH = range(4)


def corners(outline: DataFrame, grid: Grid) -> DataFrame:
    """Corners ``feature, id, next`` of directed edges ``px, py, qx, qy`` with the area to their left.

    A number holds row line, column line and the direction in which the ring comes. A ring that comes to a point where
    two areas touch turns left, so they stay apart.
    """
    across = F.when(F.col("qx") > F.col("px"), EAST).when(F.col("qx") < F.col("px"), WEST)
    towards = across.when(F.col("qy") < F.col("py"), NORTH).otherwise(SOUTH)
    bit = F.expr("shiftleft(1, towards)")
    none = F.lit(0)
    ends = outline.withColumn("towards", towards).select(
        "feature",
        F.inline(
            F.array(
                F.struct(F.col("px").alias("x"), F.col("py").alias("y"), none.alias("comes"), bit.alias("goes")),
                F.struct(F.col("qx").alias("x"), F.col("qy").alias("y"), bit.alias("comes"), none.alias("goes")),
            )
        ),
    )
    points = ends.groupBy("feature", "x", "y").agg(F.bit_or("comes").alias("comes"), F.bit_or("goes").alias("goes"))
    along_row = Window.partitionBy("feature", "y").orderBy("x")
    along_col = Window.partitionBy("feature", "x").orderBy("y")
    points = points.where("comes <> goes").select(
        "*",
        F.lag("x").over(along_row).alias("west"),
        F.lead("x").over(along_row).alias("east"),
        F.lag("y").over(along_col).alias("north"),
        F.lead("y").over(along_col).alias("south"),
    )
    comes = F.array(*(F.when(F.col("comes").bitwiseAND(1 << d) > 0, F.lit(d)) for d in range(4)))
    visits = points.withColumn("come", F.explode(F.array_compact(comes)))
    only = F.bit_count(F.col("goes") - 1)
    visits = visits.withColumn("go", F.when(F.bit_count("goes") == 1, only).otherwise((F.col("come") + 1) % 4))
    x = F.when(F.col("go") == EAST, F.col("east")).when(F.col("go") == WEST, F.col("west")).otherwise(F.col("x"))
    y = F.when(F.col("go") == NORTH, F.col("north")).when(F.col("go") == SOUTH, F.col("south")).otherwise(F.col("y"))

    def number(row: Column, col: Column, way: Column) -> Column:
        return (row.cast("long") * (grid.ncols + 1) + col) * 4 + way

    return visits.select(
        "feature", number(F.col("y"), F.col("x"), F.col("come")).alias("id"), number(y, x, F.col("go")).alias("next")
    )


def place(grid: Grid, number: str) -> tuple[Column, Column]:
    """Column and row line of a corner's number."""
    point = F.floor(F.col(number) / 4)
    return point % (grid.ncols + 1), F.floor(point / (grid.ncols + 1))


def chained(feature: np.ndarray, ids: np.ndarray, nexts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each corner the first one of its chain, its place in the chain, and whether the chain ends there.

    A chain goes on as long as the next corner is among those given; one that closes starts at its smallest number.
    """
    _, code = np.unique(feature, return_inverse=True)
    wide = int(max(ids.max(), nexts.max())) + 1
    key = code * wide + ids
    order = np.argsort(key)
    at = np.searchsorted(key[order], code * wide + nexts)
    at[at == len(key)] = 0
    follows = order[at]
    follows[key[follows] != code * wide + nexts] = -1
    led = np.zeros(len(ids), bool)
    led[follows[follows >= 0]] = True
    chain, nth, last = np.full(len(ids), -1), np.zeros(len(ids), np.int64), np.zeros(len(ids), bool)
    follow, number = follows.tolist(), ids.tolist()
    for open_ in (order[~led[order]], order):  # chains that something outside leads to, then those that close
        for start in open_.tolist():
            now, n = start, 0
            while now >= 0 and chain[now] < 0:
                chain[now], nth[now] = number[start], n
                before, now, n = now, follow[now], n + 1
            if n:
                last[before] = True
    return chain, nth, last


def _chains(block: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).select(["feature", "id", "next"])
            feature, ids, nexts = (rows.column(k).to_numpy() for k in range(3))
            chain, nth, last = chained(feature, ids, nexts)
            return pa.RecordBatch.from_arrays(
                [pa.array(a) for a in (feature, ids, nexts, chain, nth, last)], ["feature", "id", "next", "chain", "nth", "last"]
            )

        for batch in batches:
            for low in range(0, batch.num_rows, block):
                held.append(batch.slice(low, block))
                if sum(b.num_rows for b in held) >= block:
                    yield out()
                    held.clear()
        if held:
            yield out()

    return run


def ranked(chains: DataFrame) -> DataFrame:
    """(feature, chain, ring, start) of (feature, chain, to, size): the chain each one leads to and its number of corners.

    ``ring`` is the smallest chain of a ring and ``start`` the number of corners before a chain, counted from there. Every
    round is a written table; ``to`` is unique in it, so each join moves every row once, however large a ring is.
    """
    spark = chains.sparkSession
    closed = chains.where("to = chain").select("feature", "chain", F.col("chain").alias("ring"), F.lit(0).cast("long").alias("start"))
    start = chains.where("to <> chain").select(
        "feature", "chain", "size", "to", F.col("size").alias("span"), F.col("chain").alias("ring"), F.lit(0).cast("long").alias("ahead")
    )
    now, path = store(start, "ranks")
    while not now.isEmpty():
        further = now.select("feature", *(F.col(c).alias(f"_{c}") for c in ("chain", "to", "span", "ring", "ahead")))
        met = now.join(further.withColumnRenamed("_chain", "to"), ["feature", "to"])
        less = F.col("_ring") < F.col("ring")
        new, new_path = store(
            met.select(
                "feature",
                "chain",
                "size",
                F.col("_to").alias("to"),
                (F.col("span") + F.col("_span")).alias("span"),
                F.least("ring", "_ring").alias("ring"),
                F.when(less, F.col("span") + F.col("_ahead")).otherwise(F.col("ahead")).alias("ahead"),
                (F.col("ring") != F.col("_ring")).alias("open"),
            ),
            "ranks",
        )
        drop(spark, path)
        now, path = new, new_path
        if now.where("open").isEmpty():  # the stretches of a ring that follow each other agree, so each met the whole ring
            break
    whole = now.groupBy("feature", "ring").agg(F.sum("size").alias("whole"))
    before = F.when(F.col("chain") == F.col("ring"), 0).otherwise(F.col("whole") - F.col("ahead"))
    return closed.unionByName(now.join(whole, ["feature", "ring"]).select("feature", "chain", "ring", before.alias("start")))


def rings(outline: DataFrame, grid: Grid, block: int = BLOCK) -> DataFrame:
    """Corners ``feature, ring, nth, id, next`` in the order of their ring, from a directed outline."""
    column, row = place(grid, "id")
    near = corners(outline, grid).select("*", F.floor(row / SQUARE).alias("band"), F.floor(column / SQUARE).alias("part"))
    near = near.repartition("feature", "band", "part").sortWithinPartitions("feature", "band", "part", "id")
    held = stored(
        near.select("feature", "id", "next").mapInArrow(
            _chains(block), "feature long, id long, next long, chain long, nth long, last boolean"
        ),
        "chains",
    )
    ends = held.where("last").select("feature", "chain", F.col("next").alias("to"), (F.col("nth") + 1).alias("size"))
    found = held.join(ranked(ends), ["feature", "chain"])
    return found.select("feature", "ring", (F.col("start") + F.col("nth")).alias("nth"), "id", "next")


def measured(found: DataFrame, grid: Grid) -> DataFrame:
    """(feature, ring, area, top): twice the signed area in cells, negative for holes, and the uppermost left corner."""
    x, y = place(grid, "id")
    nx, ny = place(grid, "next")
    return found.groupBy("feature", "ring").agg(
        F.sum(nx * y - x * ny).alias("area"), F.min(y * (grid.ncols + 1) + x).alias("top")
    )


def homes(found: DataFrame, sizes: DataFrame, grid: Grid) -> DataFrame:
    """(feature, ring, home) of every hole: the outer ring that it lies in.

    The cell above a hole's uppermost left corner belongs to the area around the hole. The nearest upright edge to its
    left bounds that area: its ring is the outer one, or another hole of the area, which starts higher. A window holds
    one raster row of a feature.
    """
    spark = found.sparkSession
    wide = grid.ncols + 1
    asked = sizes.where("area < 0").select(
        "feature", (F.floor(F.col("top") / wide) - 1).alias("row"), (F.col("top") % wide).alias("col"), F.col("ring").alias("hole")
    )
    x, y = place(grid, "id")
    nx, ny = place(grid, "next")
    upright = found.where(x == nx).select("feature", "ring", x.alias("col"), F.least(y, ny).alias("low"), F.greatest(y, ny).alias("high"))
    rows = asked.select("feature", "row").distinct()
    edges = upright.select("feature", "ring", "col", F.explode(F.sequence("low", F.col("high") - 1)).alias("row"))
    edges = edges.join(rows, ["feature", "row"], "left_semi").withColumn("hole", F.lit(None).cast("long"))
    both = edges.unionByName(asked.withColumn("ring", F.lit(None).cast("long")))
    along = Window.partitionBy("feature", "row").orderBy("col", F.col("hole").isNotNull())
    nearest = both.withColumn("home", F.last("ring", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    now, path = store(nearest.where("hole IS NOT NULL").select("feature", F.col("hole").alias("ring"), "home"), "homes")
    while True:  # a hole that names a hole takes its home, and so on in doubled steps
        further = now.select("feature", F.col("ring").alias("home"), F.col("home").alias("_home"))
        if now.join(further, ["feature", "home"], "left_semi").isEmpty():
            return now
        met = now.join(further, ["feature", "home"], "left")
        new, new_path = store(met.select("feature", "ring", F.coalesce("_home", "home").alias("home")), "homes")
        drop(spark, path)
        now, path = new, new_path


def _joined(rows: DataFrame, keys: Sequence[str], order: Sequence[str], text: str) -> DataFrame:
    """Texts of a key's rows in order, parted by commas."""
    sorted_rows = F.array_sort(F.collect_list(F.struct(*order, text)))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(sorted_rows, lambda r: r[text]), ", ").alias("text"))


def geometries(found: DataFrame, grid: Grid) -> DataFrame:
    """(feature, geometry): GeoJSON text of each feature, outer rings by size with the holes that lie in them."""
    sizes = stored(measured(found, grid), "ring_sizes")
    held = homes(found, sizes, grid)
    rank = sizes.join(held, ["feature", "ring"], "left").withColumn("home", F.coalesce("home", "ring"))
    outer = sizes.select("feature", F.col("ring").alias("home"), F.col("area").alias("size"))
    rank = rank.join(outer, ["feature", "home"]).select("feature", "ring", "home", "size", (F.col("area") < 0).alias("hole"))
    x, y = place(grid, "id")
    point = F.concat(
        F.lit("["),
        (F.lit(grid.x0) + x.cast("double") * F.lit(grid.dx)).cast("string"),
        F.lit(", "),
        (F.lit(grid.y0) - y.cast("double") * F.lit(grid.dy)).cast("string"),
        F.lit("]"),
    )
    points = found.select("feature", "ring", "nth", F.floor(F.col("nth") / PIECE).alias("part"), point.alias("point"))
    pieces = _joined(points, ["feature", "ring", "part"], ["nth"], "point").join(rank, ["feature", "ring"])
    # The text is one value: from here on a feature's pieces of text meet, and nothing else.
    drawn = _joined(pieces.repartition("feature"), ["feature", "size", "home", "hole", "ring"], ["part"], "text")
    first = F.concat(F.substring_index("text", "]", 1), F.lit("]"))
    drawn = drawn.withColumn("text", F.concat(F.lit("["), "text", F.lit(", "), first, F.lit("]")))
    polygons = _joined(drawn, ["feature", "size", "home"], ["hole", "ring"], "text")
    polygons = polygons.withColumn("text", F.concat(F.lit("["), "text", F.lit("]")))
    whole = _joined(polygons, ["feature"], ["size", "home"], "text")
    shape = F.concat(F.lit('{"type": "MultiPolygon", "coordinates": ['), "text", F.lit("]}"))
    return whole.select("feature", shape.alias("geometry"))


def assemble_features(spans: DataFrame, grid: Grid, keys: Sequence[str], block: int = BLOCK) -> DataFrame:
    """Disjoint spans -> one feature ``keys, geometry`` (GeoJSON text) per key."""
    names = [f"key_{n}" for n in range(len(keys))]
    keyed = spans.select(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)), "row_no", "c0", "c1")
    held = stored(keyed, "feature_spans")
    numbers = stored(held.select(*names).distinct().withColumn("feature", F.monotonically_increasing_id()), "features")
    known = numbers.select(*(F.col(n).alias(f"_{n}") for n in names), "feature")
    numbered = held.join(known, [held[n].eqNullSafe(known[f"_{n}"]) for n in names]).select("feature", "row_no", "c0", "c1")
    found = stored(rings(directed_outline(numbered, ["feature"]), grid, block), "rings")
    drawn = numbers.join(geometries(found, grid), "feature")
    return drawn.select(*(F.col(n).alias(k) for k, n in zip(keys, names, strict=True)), "geometry")
