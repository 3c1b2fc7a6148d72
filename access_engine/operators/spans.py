"""Polygons on the grid as column spans.

A span ``(row_no, c0, c1)`` stands for the cells ``c0 <= col_no < c1`` of one raster row. Span
tables grow with the outline of a feature, not with its area, so overlay, union and difference
move outlines through the shuffle and leave the cell tables where they are whenever the optimizer
finds the span side small enough to broadcast.

Every window below runs over one raster row of one key after a pre-aggregation on the column, so
a window group never holds more than ``ncols + 1`` rows, however many features share that row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from access_engine.config import STRIP
from access_engine.operators.grid import Grid, strip_of


def _first_col_right_of(x: Column, grid: Grid) -> Column:
    """How many cell centres of a row satisfy ``centre < x``, clamped to the grid.

    The division gives the number up to one; comparing the neighbouring centres with ``x`` makes
    it agree with the comparison itself for every value of ``x``.
    """
    guess = F.ceil((x - F.lit(grid.x0)) / F.lit(grid.dx) - F.lit(0.5))
    exact = (
        F.when(grid.x_centre(guess - 1) >= x, guess - 1)
        .when(grid.x_centre(guess) < x, guess + 1)
        .otherwise(guess)
    )
    return F.least(F.greatest(exact, F.lit(0)), F.lit(grid.ncols)).cast("int")


def _first_row_below(y: Column, grid: Grid) -> Column:
    """How many row centres satisfy ``centre >= y``, clamped to the grid; exact like :func:`_first_col_right_of`."""
    guess = F.ceil((F.lit(grid.y0) - y) / F.lit(grid.dy) - F.lit(0.5))
    exact = (
        F.when(grid.y_centre(guess - 1) < y, guess - 1)
        .when(grid.y_centre(guess) >= y, guess + 1)
        .otherwise(guess)
    )
    return F.least(F.greatest(exact, F.lit(0)), F.lit(grid.nrows)).cast("int")


def _crossing_x(row: Column, grid: Grid) -> Column:
    """Where an edge ``x1, y1, x2, y2`` crosses the centre line of a raster row."""
    y = grid.y_centre(row)
    return (F.col("x2") - F.col("x1")) * (y - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1")


def _crossing_col(row: Column, grid: Grid) -> Column:
    return _first_col_right_of(_crossing_x(row, grid), grid)


def crossing_runs(edges: DataFrame, grid: Grid, keys: Sequence[str]) -> DataFrame:
    """:func:`row_crossings` as runs ``keys, r0, r1, col``: an edge crosses rows ``r0 <= row < r1`` at the same column.

    Every operation that leads from a row to its column is monotone, rounding included, so the columns of an edge rise or
    fall with its rows. The rows where they change are settled by the same expression, so an edge costs no more runs
    than it has rows or columns, whichever are fewer, and the runs are the crossings to the last bit.
    """
    met = (
        edges.where(F.col("y1") != F.col("y2"))
        .withColumn("first", _first_row_below(F.greatest("y1", "y2"), grid))
        .withColumn("past", _first_row_below(F.least("y1", "y2"), grid))
        .where("first < past")
        .withColumn("c_first", _crossing_col(F.col("first"), grid))
        .withColumn("c_last", _crossing_col(F.col("past") - 1, grid))
    )
    rows, way = F.col("past") - F.col("first"), F.signum(F.col("c_last") - F.col("c_first")).cast("int")
    by_col = F.abs(F.col("c_last") - F.col("c_first")) + 1 < rows
    places = F.when(by_col, F.sequence("c_first", "c_last")).otherwise(F.sequence("first", F.col("past") - 1))
    k = F.col("k")
    past_k = F.when(k == F.col("c_last"), F.col("past")).otherwise(_first_row_at("beyond", grid))
    ends = F.struct(
        F.when(F.col("by_col") & (k != F.col("c_first")), _first_row_at("k", grid))
        .otherwise(F.when(F.col("by_col"), F.col("first")).otherwise(k))
        .alias("r0"),
        F.when(F.col("by_col"), past_k).otherwise(k + 1).alias("r1"),
    )
    # a generator, so that the rows are settled once and not for every use of them
    return (
        met.withColumn("way", way)
        .select("*", by_col.alias("by_col"), F.explode(places).alias("k"))
        .withColumn("beyond", k + F.col("way"))
        .withColumn("k_guess", _guessed_row("k", grid))
        .withColumn("beyond_guess", _guessed_row("beyond", grid))
        .select(*keys, "x1", "y1", "x2", "y2", F.inline(F.array(ends)))
        .where("r0 < r1")
        .select(*keys, "r0", "r1", _crossing_col(F.col("r0"), grid).alias("col"))
    )


def _border(col: str, grid: Grid) -> Column:
    """The column centre that an edge passes when it comes to ``col`` from the column before."""
    return grid.x_centre(F.when(F.col("way") > 0, F.col(col) - 1).otherwise(F.col(col)))


def _guessed_row(col: str, grid: Grid) -> Column:
    """About where an edge comes to ``col``, by the inverse of the edge."""
    away = (_border(col, grid) - F.col("x1")) * (F.col("y2") - F.col("y1"))
    y = F.col("y1") + F.try_divide(away, F.col("x2") - F.col("x1"))
    guess = F.ceil((F.lit(grid.y0) - y) / F.lit(grid.dy) - F.lit(0.5))
    return F.least(F.greatest(guess, F.col("first")), F.col("past")).cast("int")


def _first_row_at(col: str, grid: Grid) -> Column:
    """First row from ``first`` on whose column is ``col`` or lies beyond it; ``past`` where there is none.

    The inverse of the edge tells the row up to one unless the edge is so steep that rounding counts; a guess that the
    rows next to it don't bear out is replaced by bisection.
    """
    first, past, guess, border = F.col("first"), F.col("past"), F.col(f"{col}_guess"), _border(col, grid)

    def there(row: Column) -> Column:
        x = _crossing_x(row, grid)
        return F.when(F.col("way") > 0, border < x).otherwise(border >= x)

    def halve(left: Column, _: Column) -> Column:
        middle = F.floor((left["low"].cast("long") + left["high"]) / 2).cast("int")
        more, reached = left["low"] < left["high"], there(middle)
        return F.struct(
            F.when(more & ~reached, middle + 1).otherwise(left["low"]).alias("low"),
            F.when(more & reached, middle).otherwise(left["high"]).alias("high"),
        )

    steps = F.sequence(F.lit(0), F.ceil(F.log2(past - first + 1)).cast("int"))
    found = F.aggregate(steps, F.struct(first.alias("low"), past.alias("high")), halve, lambda left: left["low"])
    for near in (guess + 1, guess - 1, guess):
        inside = (near >= first) & (near <= past)
        right = ((near == first) | ~there(near - 1)) & ((near == past) | there(near))
        found = F.when(inside & right, near).otherwise(found)
    return found


def row_crossings(edges: DataFrame, grid: Grid, keys: Sequence[str]) -> DataFrame:
    """Where polygon edges ``x1, y1, x2, y2`` cross the centre lines of raster rows.

    An edge counts for the centre ``y`` iff ``(y1 > y) <> (y2 > y)``, so a vertex on a centre
    line counts once and two units sharing an edge never share a cell.
    """
    first = F.floor((F.lit(grid.y0) - F.greatest("y1", "y2")) / F.lit(grid.dy) - F.lit(0.5)) - 1
    last = F.ceil((F.lit(grid.y0) - F.least("y1", "y2")) / F.lit(grid.dy) - F.lit(0.5)) + 1
    y = grid.y_centre(F.col("row_no"))
    return (
        edges.where(F.col("y1") != F.col("y2"))
        .withColumn("r0", F.least(F.greatest(first, F.lit(0)), F.lit(grid.nrows)).cast("int"))
        .withColumn("r1", F.greatest(F.least(last, F.lit(grid.nrows - 1)), F.lit(-1)).cast("int"))
        .where(F.col("r0") <= F.col("r1"))
        .select(*keys, "x1", "y1", "x2", "y2", F.explode(F.sequence("r0", "r1")).alias("row_no"))
        .where((F.col("y1") > y) != (F.col("y2") > y))
        .select(
            *keys,
            "row_no",
            _crossing_col(F.col("row_no"), grid).alias("col"),
        )
    )


def _pair(boundaries: DataFrame, keys: Sequence[str], line: str = "row_no") -> DataFrame:
    """Join every first boundary of a row with the one that follows it."""
    along = Window.partitionBy(*keys, line).orderBy("col")
    return (
        boundaries.select(
            *keys,
            line,
            F.col("col").alias("c0"),
            F.lead("col").over(along).alias("c1"),
            F.row_number().over(along).alias("nth"),
        )
        .where(F.col("nth") % 2 == 1)
        .drop("nth")
    )


def odd_spans(toggles: DataFrame, keys: Sequence[str], line: str = "row_no") -> DataFrame:
    """Spans where an odd number of ``col`` values lies to one side (even-odd rule).

    Equal columns cancel in pairs before the window, which keeps the window group within the
    grid width.
    """
    odd = (
        toggles.groupBy(*keys, line, "col")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") % 2 == 1)
    )
    return _pair(odd, keys, line)


def rasterise(edges: DataFrame, grid: Grid, keys: Sequence[str]) -> DataFrame:
    """Closed rings given as edges -> the spans of cells whose centre lies inside.

    All rings of a feature go in together: holes and further parts follow from the even-odd rule.
    """
    return odd_spans(row_crossings(edges, grid, keys), keys)


def rasterise_blocks(edges: DataFrame, grid: Grid, keys: Sequence[str]) -> DataFrame:
    """Closed rings given as edges -> blocks ``keys, r0, r1, c0, c1`` of the cells whose centre lies inside.

    The cells are those of :func:`rasterise`; rows of a feature between which no crossing moves form one block, so a
    feature on a grid of any height costs what its outline crosses, columns or rows. Features are parted into at most 64
    heights of the grid; a window holds one feature in one of these.
    """
    height = max(64, -(-grid.nrows // 64))
    part = F.explode(F.sequence(strip_of(F.col("r0"), height), strip_of(F.col("r1") - 1, height)))
    cut = (
        crossing_runs(edges, grid, keys)
        .withColumn("part", part)
        .withColumn("r0", F.greatest("r0", F.col("part") * height))
        .withColumn("r1", F.least("r1", (F.col("part") + 1) * height))
    )
    own = [*keys, "part"]
    # where a column begins or ceases to be crossed; equal runs cancel in pairs
    turns = (
        cut.select(*own, F.explode(F.array("r0", "r1")).alias("row"), F.col("col").alias("line"))
        .groupBy(*own, "row", "line")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") % 2 == 1)
    )
    numbered = turns.select(
        *own, "row", "line", F.dense_rank().over(Window.partitionBy(*own).orderBy("row")).alias("nth")
    )
    along = Window.partitionBy(*own, "line").orderBy("row")
    crossed = numbered.select(
        *own,
        "line",
        F.col("nth").alias("first"),
        F.lead("nth").over(along).alias("past"),
        F.row_number().over(along).alias("turn"),
    ).where("turn % 2 = 1")
    crossed = crossed.select(
        *own, F.explode(F.sequence("first", F.col("past") - 1)).alias("nth"), F.col("line").alias("col")
    )
    # the rows from one turn of a feature to the next, put before the columns that are crossed between them
    rows = numbered.select(*own, "row", "nth").distinct()
    rows = rows.select(*own, "nth", "row", F.lead("row").over(Window.partitionBy(*own).orderBy("nth")).alias("until"))
    none = F.lit(None).cast("int")
    both = rows.select(*own, "nth", F.lit(-1).alias("col"), "row", "until").unionByName(
        crossed.select(*own, "nth", "col", none.alias("row"), none.alias("until"))
    )
    across = Window.partitionBy(*own, "nth").orderBy("col")
    paired = both.select(
        *keys,
        F.first("row").over(across).alias("r0"),
        F.first("until").over(across).alias("r1"),
        F.col("col").alias("c0"),
        F.lead("col").over(across).alias("c1"),
        F.row_number().over(across).alias("place"),
    )
    return paired.where("place % 2 = 0").drop("place")


def merge_blocks(blocks: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Union of overlapping blocks ``r0, r1, c0, c1`` per key, as merged spans of every raster row.

    A block changes the number of open blocks at its four corners. Equal corners are summed before any row is unfolded, so
    what is unfolded grows with the grid and not with the blocks on it. One window runs over a column line, the other over
    a raster row, of one key.
    """
    corner = [(r, c, 1 if (r, c) in (("r0", "c0"), ("r1", "c1")) else -1) for r in ("r0", "r1") for c in ("c0", "c1")]
    corners = F.inline(
        F.array(*[F.struct(F.col(r).alias("row"), F.col(c).alias("col"), F.lit(s).alias("step")) for r, c, s in corner])
    )
    turns = blocks.select(*keys, corners).groupBy(*keys, "col", "row").agg(F.sum("step").alias("step"))
    down = Window.partitionBy(*keys, "col").orderBy("row")
    runs = (
        turns.where("step <> 0")
        .select(*keys, "col", "row", F.lead("row").over(down).alias("until"), F.sum("step").over(down).alias("step"))
        .where("step <> 0")
    )
    rows = F.explode(F.sequence("row", F.col("until") - 1)).alias("row_no")
    return _swept(runs.select(*keys, "col", "step", rows), keys)


def merge_spans(spans: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Union of overlapping spans per key: dissolve without exploding any cell.

    Each span opens at ``c0`` and closes at ``c1``; where the running number of open spans leaves
    zero a merged span begins, where it returns to zero it ends.
    """
    ends = (
        spans.select(
            *keys,
            "row_no",
            F.explode(
                F.array(
                    F.struct(F.col("c0").alias("col"), F.lit(1).alias("step")),
                    F.struct(F.col("c1").alias("col"), F.lit(-1).alias("step")),
                )
            ).alias("e"),
        )
        .groupBy(*keys, "row_no", F.col("e.col").alias("col"))
        .agg(F.sum("e.step").alias("step"))
        .where(F.col("step") != 0)
    )
    return _swept(ends, keys)


def _swept(ends: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Merged spans from the changes ``step`` of the number of open spans along each row."""
    along = Window.partitionBy(*keys, "row_no").orderBy("col")
    steps = ends.withColumn("open", F.sum("step").over(along))
    edge = (F.col("open") == 0) | (F.col("open") == F.col("step"))
    return _pair(steps.where(edge).select(*keys, "row_no", "col"), keys)


def complement_spans(
    merged: DataFrame, grid: Grid, datasets: DataFrame | None = None
) -> DataFrame:
    """The spans of the grid that ``merged`` leaves free, for every key row of ``datasets``.

    Toggling the merged spans inside a span over the whole row leaves the gaps. ``datasets`` holds
    one row per dataset (file) and its columns are the keys of ``merged``; without it there is one
    dataset and no key.
    """
    keys = datasets.columns if datasets is not None else []
    rows = F.sequence(F.lit(0), F.lit(grid.nrows - 1))
    source = datasets if datasets is not None else merged.sparkSession.range(1)
    whole = source.select(
        *keys, F.explode(rows).alias("row_no"), F.lit(0).alias("c0"), F.lit(grid.ncols).alias("c1")
    )
    toggles = whole.unionByName(merged.select(*keys, "row_no", "c0", "c1")).select(
        *keys, "row_no", F.explode(F.array("c0", "c1")).alias("col")
    )
    return odd_spans(toggles, keys)


def intersect_spans(
    a: DataFrame, b: DataFrame, keys: Sequence[str], width: int = STRIP
) -> DataFrame:
    """Overlay two span layers: the spans both cover, with the ``keys`` of both.

    Spans are cut at strip borders, met within (row, strip) and melted together again; no cell is
    touched.
    """

    left = cut_by_strip(a, width)
    right = cut_by_strip(b, width).withColumnsRenamed({"c0": "b0", "c1": "b1"})
    both = left.join(right, ["row_no", "strip"]).where("c0 < b1 and b0 < c1")
    start, end = F.greatest("c0", "b0").alias("c0"), F.least("c1", "b1").alias("c1")
    return merge_spans(both.select(*keys, "row_no", start, end), keys)


def burn(spans: DataFrame) -> DataFrame:
    """Spans -> one row per cell, for results that need cells."""
    others = [c for c in spans.columns if c not in ("c0", "c1")]
    cols = F.sequence(F.col("c0"), F.col("c1") - 1)
    return spans.select(*others, F.explode(cols).alias("col_no"))


def _by_strip(spans: DataFrame, width: int) -> DataFrame:
    return spans.withColumn(
        "strip",
        F.explode(
            F.sequence(strip_of(F.col("c0"), width), strip_of(F.col("c1") - F.lit(1), width))
        ),
    )


def cut_by_strip(spans: DataFrame, width: int = STRIP) -> DataFrame:
    """Spans cut at strip borders, with the ``strip`` of each piece."""
    return (
        _by_strip(spans, width)
        .withColumn("c0", F.greatest("c0", F.col("strip") * width))
        .withColumn("c1", F.least("c1", (F.col("strip") + 1) * width))
    )


def locate(
    cells: DataFrame, spans: DataFrame, how: str = "inner", width: int = STRIP
) -> DataFrame:
    """Join cells ``row_no, col_no`` with the spans they lie in.

    The equi-key is (row, column strip): a key holds at most ``width`` cells of a layer, and the
    spans cut by strip are the only thing multiplied. ``how`` is ``inner``, ``left`` or
    ``left_anti`` (cells outside every span).
    """
    side = _by_strip(spans, width).withColumnRenamed("row_no", "span_row")
    joined = cells.withColumn("cell_strip", strip_of(F.col("col_no"), width)).join(
        side,
        (F.col("row_no") == F.col("span_row"))
        & (F.col("cell_strip") == F.col("strip"))
        & (F.col("col_no") >= F.col("c0"))
        & (F.col("col_no") < F.col("c1")),
        how,
    )
    return joined.drop("cell_strip", "strip", "span_row", "c0", "c1")


def overlay_spans(
    a: DataFrame, b: DataFrame, how: str = "or", on: Sequence[str] = ()
) -> DataFrame:
    """Overlay two span layers in one sweep along each raster row; no cell and no pair of spans is formed.

    ``on`` are columns of both layers that part them into datasets. Each layer's other columns name its features, which
    must not overlap within the layer. The sweep carries the feature of either layer that is open: ``or`` gives the
    pieces of both layers and the leftovers of each, with NULL for the other's columns, ``and`` the common pieces,
    ``not`` what ``b`` leaves of ``a``. Neighbouring pieces of equal features are one. A window holds the places where
    spans of one row and dataset begin or end.
    """
    place = ("row_no", "c0", "c1", *on)
    names = [[c for c in layer.columns if c not in place] for layer in (a, b)]
    if set(names[0]) & set(names[1]):
        raise ValueError(f"both layers have columns {sorted(set(names[0]) & set(names[1]))}")
    held = [F.struct(*(F.col(c) for c in own), F.lit(True).alias("is_open")) for own in names]
    blank = [
        F.struct(
            *(F.lit(None).cast(layer.schema[c].dataType).alias(c) for c in own),
            F.lit(False).alias("is_open"),
        )
        for layer, own in zip((a, b), names)
    ]

    def steps(layer: DataFrame, side: int) -> DataFrame:
        """Where spans begin, with their feature, and where they end."""
        ends = [
            F.struct(F.col(end).alias("col"), F.lit(step).alias("step")) for end, step in (("c0", 1), ("c1", -1))
        ]
        rows = layer.where("c0 < c1").select(*on, "row_no", held[side].alias("feature"), F.inline(F.array(*ends)))
        columns = []
        for other in (0, 1):
            own = F.col("feature") if other == side else F.lit(None).cast(_kind(blank[other], rows))
            columns += [
                F.when(F.col("step") > 0, own).alias(f"begins_{other}"),
                F.when(F.lit(other == side), F.col("step")).otherwise(0).alias(f"step_{other}"),
                F.lit(other == side).alias(f"any_{other}"),
                F.when((F.col("step") > 0) & F.lit(other == side), 1).otherwise(0).alias(f"many_{other}"),
            ]
        return rows.select(*on, "row_no", "col", *columns)

    along = Window.partitionBy(*on, "row_no").orderBy("col")
    points = steps(a, 0).unionByName(steps(b, 1)).groupBy(*on, "row_no", "col")
    merged = points.agg(
        *(
            one
            for k in (0, 1)
            for one in (
                F.max(f"begins_{k}").alias(f"begins_{k}"),
                F.sum(f"step_{k}").alias(f"step_{k}"),
                F.max(f"any_{k}").alias(f"any_{k}"),
                F.sum(f"many_{k}").alias(f"many_{k}"),
            )
        )
    )
    swept = merged
    for k in (0, 1):
        now = F.when(F.col(f"any_{k}"), F.coalesce(F.col(f"begins_{k}"), blank[k]))
        swept = swept.withColumn(f"now_{k}", F.coalesce(F.last(now, ignorenulls=True).over(along), blank[k]))
        swept = swept.withColumn(f"open_{k}", F.sum(f"step_{k}").over(along))
    wrong = F.greatest("open_0", "open_1", "many_0", "many_1") > 1
    refused = F.raise_error(F.format_string("features of a layer overlap in row %s", "row_no"))
    state = F.struct("now_0", "now_1")
    swept = swept.withColumn("state", F.when(wrong, refused).otherwise(state))
    changed = ~F.col("state").eqNullSafe(F.lag("state").over(along))
    turns = swept.withColumn("changed", changed).where("changed")
    pieces = turns.select(*on, "row_no", F.col("col").alias("c0"), F.lead("col").over(along).alias("c1"), "state.*")
    first, second = F.col("now_0.is_open"), F.col("now_1.is_open")
    wanted = {"or": first | second, "and": first & second, "not": first & ~second}[how]
    kept = names[0] if how == "not" else [*names[0], *names[1]]
    columns = [F.col(f"now_{int(c in names[1])}.{c}").alias(c) for c in kept]
    return pieces.where(wanted).select(*on, *columns, "row_no", "c0", "c1")


def _kind(column: Column, df: DataFrame):
    return df.select(column.alias("c")).schema["c"].dataType
