"""Polygons on the grid: even-odd rule, borders, union, gaps, location."""

import random

import pytest

from conftest import plan_of

from access_engine.operators.grid import Grid, align, resample, same_srid
from access_engine.operators.prefix import running_sums, span_sums
from access_engine.operators.overlay import unstack
from access_engine.operators.segments import by_layer, to_segments
from access_engine.operators.spans import (
    burn,
    complement_spans,
    crossing_runs,
    intersect_spans,
    locate,
    merge_blocks,
    merge_spans,
    overlay_spans,
    rasterise,
    rasterise_blocks,
    row_crossings,
)

GRID = Grid(0.0, 20.0, 1.0, 1.0, 30, 20)


def edges_of(rings, feature=1):
    """Edges of closed rings given as point lists."""
    return [
        (feature, float(a[0]), float(a[1]), float(b[0]), float(b[1]))
        for ring in rings
        for a, b in zip(ring, ring[1:] + ring[:1])
    ]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id int, x1 double, y1 double, x2 double, y2 double")


def parity_cells(edges, grid):
    """Cell centres inside, one by one, by counting crossings to the right."""
    found = set()
    for feature in {e[0] for e in edges}:
        for row in range(grid.nrows):
            y = grid.y0 - (row + 0.5) * grid.dy
            for col in range(grid.ncols):
                x = grid.x0 + (col + 0.5) * grid.dx
                n = sum(
                    1
                    for f, x1, y1, x2, y2 in edges
                    if f == feature
                    and (y1 > y) != (y2 > y)
                    and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1
                )
                if n % 2:
                    found.add((feature, row, col))
    return found


def burnt(spark, edges, grid=GRID):
    rows = burn(rasterise(frame(spark, edges), grid, ["id"])).collect()
    cells = [(r.id, r.row_no, r.col_no) for r in rows]
    assert len(cells) == len(set(cells))
    return set(cells)


SHAPES = {
    "square": [[(2, 2), (8, 2), (8, 9), (2, 9)]],
    "concave": [[(1, 1), (15, 1), (15, 15), (8, 4), (1, 15)]],
    "hole": [[(1, 1), (18, 1), (18, 18), (1, 18)], [(5, 5), (12, 6), (11, 13), (6, 12)]],
    "two parts": [[(1, 1), (4, 1), (4, 4)], [(10, 10), (20, 11), (14, 18)]],
    "vertex on a centre": [[(2.5, 2.5), (10.5, 2.5), (10.5, 12.5), (2.5, 12.5)]],
    "sticks out of the grid": [[(-10, -5), (45, 3), (35, 30), (-4, 25)]],
    "off the grid": [[(40, 40), (50, 40), (45, 50)]],
    "very far out": [[(-1e15, -1e15), (1e15, -1e15), (1e15, 1e15)], [(1e14, -1e14), (1e14, -1e15), (3e14, -1e15)]],
    "self crossing": [[(1, 1), (20, 18), (20, 1), (1, 18)]],
}


@pytest.mark.parametrize("name", SHAPES)
def test_rasterise_equals_parity(spark, name):
    edges = edges_of(SHAPES[name])
    assert burnt(spark, edges) == parity_cells(edges, GRID)


def test_random_polygons_on_an_uneven_grid(spark):
    rng = random.Random(3)
    grid = Grid(-3.3, 11.7, 0.37, 0.61, 40, 25)
    edges = []
    for feature in range(12):
        ring = [(rng.uniform(-5, 13), rng.uniform(-5, 13)) for _ in range(rng.randint(3, 9))]
        edges += edges_of([ring], feature)
    assert burnt(spark, edges, grid) == parity_cells(edges, grid)


def test_shared_border_gives_every_cell_to_one_unit(spark):
    left = [(0, 0), (10.5, 0), (13.5, 9.5), (10.5, 20), (0, 20)]
    right = [(10.5, 0), (30, 0), (30, 20), (10.5, 20), (13.5, 9.5)]
    cells = burnt(spark, edges_of([left], 1) + edges_of([right], 2))
    assert sorted((r, c) for _, r, c in cells) == [(r, c) for r in range(20) for c in range(30)]


def test_empty_layer(spark):
    assert burnt(spark, edges_of(SHAPES["off the grid"])) == set()
    assert merge_spans(rasterise(frame(spark, []), GRID, ["id"]), ["id"]).count() == 0


def test_merge_and_complement(spark):
    rng = random.Random(5)
    spans = []
    for key in ("a", "b"):
        for _ in range(200):
            c0 = rng.randint(0, 28)
            spans.append((key, rng.randint(0, 15), c0, rng.randint(c0 + 1, 30)))
    df = spark.createDataFrame(spans, "k string, row_no int, c0 int, c1 int")
    merged = merge_spans(df, ["k"])
    want = {(k, r, c) for k, r, c0, c1 in spans for c in range(c0, c1)}
    cells = [(x.k, x.row_no, x.col_no) for x in burn(merged).collect()]
    assert len(cells) == len(want) and set(cells) == want
    names = spark.createDataFrame([("a",), ("b",), ("none",)], "k string")
    free = [(x.k, x.row_no, x.col_no) for x in burn(complement_spans(merged, GRID, names)).collect()]
    every = {(k, r, c) for k in ("a", "b", "none") for r in range(20) for c in range(30)}
    assert len(free) == len(set(free)) and set(free) == every - want


def test_intersection(spark):
    rng = random.Random(8)
    a, b = set(), set()
    for cells, start in ((a, 0), (b, 5)):
        for _ in range(60):
            row, c0 = rng.randint(0, 5), rng.randint(start, 25)
            cells |= {(k, row, c) for c in range(c0, c0 + 4) for k in (1, 2)}
    def spans(cells, key):
        rows = [(k, r, c, c + 1) for k, r, c in cells]
        return merge_spans(spark.createDataFrame(rows, f"{key} int, row_no int, c0 int, c1 int"), [key])
    both = burn(intersect_spans(spans(a, "i"), spans(b, "j"), ["i", "j"], width=4)).collect()
    got = [(r.i, r.j, r.row_no, r.col_no) for r in both]
    want = {(i, j, r, c) for i, r, c in a for j in (1, 2) if (j, r, c) in b}
    assert len(got) == len(want) and set(got) == want


def test_touching_spans_melt(spark):
    df = spark.createDataFrame([(0, 1, 4), (0, 4, 9), (0, 12, 13)], "row_no int, c0 int, c1 int")
    assert sorted((r.c0, r.c1) for r in merge_spans(df).collect()) == [(1, 9), (12, 13)]


def test_hot_spot_of_catchments(spark):
    """20,000 catchments over the same rows: the union has one span per row."""
    many = spark.range(20000).selectExpr(
        "explode(sequence(0, 19)) as row_no", "int(id % 10) as c0", "int(20 + id % 10) as c1"
    )
    rows = merge_spans(many).collect()
    assert sorted((r.row_no, r.c0, r.c1) for r in rows) == [(r, 0, 29) for r in range(20)]


def test_locate_across_strips(spark):
    spans = spark.createDataFrame(
        [(1, 0, 3, 17), (2, 0, 10, 12), (1, 2, 0, 30)], "id int, row_no int, c0 int, c1 int"
    )
    cells = spark.range(20 * 30).selectExpr("int(id / 30) as row_no", "int(id % 30) as col_no")
    inside = {(r.id, r.row_no, r.col_no) for r in locate(cells, spans, width=4).collect()}
    assert inside == (
        {(1, 0, c) for c in range(3, 17)}
        | {(2, 0, c) for c in (10, 11)}
        | {(1, 2, c) for c in range(30)}
    )
    outside = locate(cells, spans, "left_anti", width=4)
    assert outside.count() == 600 - 14 - 30


def test_align_drops_points_outside(spark):
    points = spark.createDataFrame([(0.0, 19.9), (29.9, 0.1), (-0.1, 5.0), (5.0, 20.5), (1e300, 5.0), (float("nan"), 5.0)], "x double, y double")
    rows = {(r.row_no, r.col_no) for r in align(points, GRID).collect()}
    assert rows == {(0, 0), (19, 29)}


def test_reference_systems_must_agree():
    other = Grid(0.0, 1.0, 1.0, 1.0, 1, 1, srid=4326)
    assert same_srid(GRID, 32644) == 32644
    with pytest.raises(ValueError):
        same_srid(GRID, other)


def test_left_join_keeps_cells_outside(spark):
    spans = spark.createDataFrame([(1, 0, 0, 2)], "id int, row_no int, c0 int, c1 int")
    cells = spark.range(4).selectExpr("0 as row_no", "int(id) as col_no")
    rows = locate(cells, spans, "left").orderBy("col_no").collect()
    assert [r.id for r in rows] == [1, 1, None, None]


@pytest.mark.parametrize("width", [3, 8, 64])
def test_running_sums_equal_the_sum_of_cells(spark, width):
    """Missing strips and rows, missing values, spans of one cell, whole rows and beyond what is stored."""
    rng = random.Random(6)
    grid = Grid(0.0, 9.0, 1.0, 1.0, 29, 9)
    cells = {(r, c): rng.choice([None, 0.0, 1.5, 7.0]) for r in range(8) for c in range(29) if r != 4 and not 6 <= c < 15}
    spans = [(k % 4, r, c0, c0 + n) for k in range(60) for r, c0, n in [(rng.randrange(9), rng.randrange(29), rng.randint(0, 9))]]
    spans = [(k, r, c0, min(c1, 29)) for k, r, c0, c1 in spans] + [(5, r, 0, 29) for r in range(9)] + [(6, 4, 3, 20), (6, 0, 7, 14)]
    held = to_segments(spark.createDataFrame([(*k, v) for k, v in cells.items()], "row_no int, col_no int, pop double"), "pop", width=width)
    frame = spark.createDataFrame(spans, "id int, row_no int, c0 int, c1 int")
    found = span_sums(frame, running_sums(held, "pop", grid, width), ["id"], width=width).collect()
    wanted = {}
    for k, r, c0, c1 in spans:
        own = [cells.get((r, c)) for c in range(c0, c1)]
        total, n = wanted.get(k, (0.0, 0))
        wanted[k] = total + sum(v for v in own if v is not None), n + sum(v is not None for v in own)
    assert {r.id: (r.pop_sum, r.pop_count) for r in found} == {k: (t if n else None, n) for k, (t, n) in wanted.items()}
    assert span_sums(frame.limit(0), running_sums(held, "pop", grid, width), ["id"], width=width).count() == 0
    assert running_sums(held.limit(0), "pop", grid, width).count() == 0


def test_running_sums_unfold_no_cell(spark):
    held = to_segments(spark.createDataFrame([(0, 0, 1.0)], "row_no int, col_no int, pop double"), "pop")
    spans = spark.createDataFrame([(1, 0, 0, 1)], "id int, row_no int, c0 int, c1 int")
    plan = plan_of(span_sums(spans, running_sums(held, "pop", Grid(0.0, 1.0, 1.0, 1.0, 1, 1)), ["id"]))
    assert "posexplode" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_running_sums_refuse_what_would_spoil_a_row(spark):
    bad = spark.createDataFrame([(0, 0, [1.0, float("nan")])], "row_no int, strip int, pop array<double>")
    with pytest.raises(Exception, match="finite"):
        running_sums(bad, "pop", Grid(0.0, 1.0, 1.0, 1.0, 2, 1)).collect()


@pytest.mark.parametrize("how", ["or", "and", "not"])
def test_overlay_of_spans_equals_that_of_cells(spark, how):
    rng = random.Random(9)

    def layer(datasets, rows):
        out = []
        for d in range(datasets):
            for r in range(rows):
                col = 0
                while col < 25:
                    size = rng.randint(1, 6)
                    if rng.random() < 0.7:
                        out.append((d, rng.choice([1, 2, None]), r, col, col + size))
                    col += size
        return out

    a, b = layer(2, 5), layer(2, 7)
    one = spark.createDataFrame(a, "d int, id int, row_no int, c0 int, c1 int")
    two = spark.createDataFrame(b, "d int, band int, row_no int, c0 int, c1 int")
    cells = [{(d, r, c): k for d, k, r, c0, c1 in rows for c in range(c0, c1)} for rows in (a, b)]
    keys = {"or": cells[0].keys() | cells[1].keys(), "and": cells[0].keys() & cells[1].keys(), "not": cells[0].keys() - cells[1].keys()}[how]
    wanted = sorted(((*k, cells[0].get(k), cells[1].get(k))[: 4 if how == "not" else 5] for k in keys), key=str)
    found = burn(overlay_spans(one, two, how, ["d"]))
    columns = ["d", "row_no", "col_no", "id"] + ["band"] * (how != "not")
    assert sorted((tuple(r) for r in found.select(*columns).collect()), key=str) == wanted
    pieces = overlay_spans(one, two, how, ["d"]).collect()
    ends = {(r.d, r.row_no, r.c1): (r.id, None if how == "not" else r.band) for r in pieces}
    if how == "or":  # features named NULL may still meet a leftover; all else that touches differs
        same = [r for r in pieces if ends.get((r.d, r.row_no, r.c0)) == (r.id, r.band) and r.id is not None and r.band is not None]
        assert not same
    assert overlay_spans(one.limit(0), two, how, ["d"]).count() == (len(overlay_spans(two, one.limit(0), "or", ["d"]).collect()) if how == "or" else 0)


def test_overlapping_features_of_a_layer_are_refused(spark):
    two = spark.createDataFrame([(7, 0, 0, 3)], "band int, row_no int, c0 int, c1 int")
    for spans in ([(1, 0, 0, 5), (2, 0, 4, 9)], [(1, 0, 0, 5), (2, 0, 0, 2)], [(1, 0, 0, 5), (1, 0, 0, 5)]):
        one = spark.createDataFrame(spans, "id int, row_no int, c0 int, c1 int")
        with pytest.raises(Exception, match="overlap in row 0"):
            overlay_spans(one, two).collect()
    with pytest.raises(ValueError, match="both layers"):
        overlay_spans(two, two)


@pytest.mark.parametrize("target", [
    Grid(0.0, 20.0, 1.0, 1.0, 30, 20),
    Grid(-3.0, 24.0, 0.7, 2.3, 60, 15),
    Grid(-3.0, 24.0, 7.0, 0.3, 6, 100),
    Grid(4.5, 13.25, 2.0, 2.0, 5, 4),
])
def test_resampling_keeps_what_lies_inside(spark, target):
    rng = random.Random(5)
    cells = {(r, c): rng.choice([None, 1.0, 3.25]) for r in range(20) for c in range(30)}
    frame = spark.createDataFrame([(*k, v) for k, v in cells.items()], "row_no int, col_no int, pop double")
    found = {(r.row_no, r.col_no): r.pop for r in resample(frame, "pop", GRID, target).collect()}
    wanted = {}
    for (r, c), v in cells.items():
        for i in range(target.nrows if v else 0):
            top = target.y0 - i * target.dy
            h = min(20.0 - r, top) - max(19.0 - r, top - target.dy)
            for j in range(target.ncols if h > 1e-9 else 0):
                left = target.x0 + j * target.dx
                w = min(c + 1, left + target.dx) - max(c, left)
                if w > 1e-9:
                    wanted[i, j] = wanted.get((i, j), 0.0) + v * w * h
    assert {k: pytest.approx(v) for k, v in wanted.items()} == {k: v for k, v in found.items() if v > 1e-8}
    if target.x0 < 0:  # the target covers all of the source
        assert sum(found.values()) == pytest.approx(sum(v for v in cells.values() if v))
    if target == GRID:
        assert found == {k: v for k, v in cells.items() if v}


def test_resampling_between_reference_systems_is_refused(spark):
    frame = spark.createDataFrame([(0, 0, 1.0)], "row_no int, col_no int, pop double")
    with pytest.raises(ValueError):
        resample(frame, "pop", GRID, Grid(0.0, 20.0, 1.0, 1.0, 30, 20, 4326))


def test_runs_of_an_edge_are_its_crossings(spark):
    """Flat, steep and nearly upright edges; few columns on many rows and the reverse, corners on centres."""
    rng = random.Random(8)
    edges = [(n, *(rng.uniform(-5, 35) for _ in range(4))) for n in range(60)]
    edges += [(60 + n, *(float(rng.randrange(-2, 60)) / 2 for _ in range(4))) for n in range(60)]
    edges += [(120 + n, 4.5 + d, -1.0, 4.5 + e, 21.0) for n, (d, e) in enumerate([(0, 0), (-1e-15, 1e-15), (1e-14, -1e-14), (0, 3e-16)])]
    for grid in (GRID, Grid(0.0, 20.0, 3.0, 0.05, 10, 400), Grid(0.0, 20.0, 0.05, 3.0, 600, 7)):
        df = frame(spark, edges)
        want = sorted((r.id, r.row_no, r.col) for r in row_crossings(df, grid, ["id"]).collect())
        runs = crossing_runs(df, grid, ["id"]).collect()
        assert sorted((r.id, row, r.col) for r in runs for row in range(r.r0, r.r1)) == want
        per_edge = max(sum(r.id == n for r in runs) for n in range(124))
        assert per_edge <= min(grid.ncols + 1, grid.nrows)


def test_union_of_blocks_equals_union_of_rows(spark):
    """Overlapping stars with holes, ids and datasets that repeat or are missing; a tall grid has rows to save."""
    rng = random.Random(9)
    rows = []
    for n in range(40):
        cx, cy, size = rng.randrange(30), rng.randrange(20), rng.uniform(1, 9)
        ring = [(cx + rng.uniform(-size, size), cy + rng.uniform(-size, size)) for _ in range(rng.choice([3, 4, 7]))]
        key, dataset = (None if n == 7 else n // 2), rng.choice(["a", "b", None])
        rows += [(dataset, *e) for e in edges_of([ring, [(cx, cy), (cx + 2, cy), (cx + 2, cy + 2)]], key)]
    df = spark.createDataFrame(rows, "d string, id int, x1 double, y1 double, x2 double, y2 double")
    for grid in (GRID, Grid(0.0, 20.0, 3.0, 0.1, 10, 200)):
        merged = merge_blocks(rasterise_blocks(df, grid, ["d", "id"]).drop("id"), ["d"])
        want = merge_spans(rasterise(df, grid, ["d", "id"]).drop("id"), ["d"])
        assert merged.dtypes == want.dtypes
        assert sorted(map(str, merged.collect())) == sorted(map(str, want.collect()))


def test_covering_a_taller_grid_unfolds_no_feature(spark):
    """What catchments cost does not grow with the rows of the grid: about as many blocks on ten times the rows."""
    rows = [e for n in range(30) for e in edges_of([[(n % 7, 3), (n % 7 + 6, 9), (n % 7, 16)]], n)]
    counts = [
        rasterise_blocks(frame(spark, rows), Grid(0.0, 20.0, 1.0, 20 / n, 30, n), ["id"]).count() for n in (6400, 64000)
    ]
    assert counts[1] < 1.5 * counts[0]


def test_layers_are_parted_after_their_cells_are_gathered(spark):
    """Gaps, cells without a value, several strips: the segments of the long raster, from one shuffled row a cell."""
    cells = [(r, c, [None if (r * c + k) % 5 == 0 else float(r + c * k) for k in range(3)]) for r in range(3) for c in range(0, 13, r + 1)]
    stack = spark.createDataFrame(cells, "row_no int, col_no int, hours array<double>")
    found = unstack(by_layer(to_segments(stack, "hours", width=4), "hours"), "row_no", "strip")
    want = to_segments(unstack(stack, "row_no", "col_no"), "hours", ["layer"], 4).select(found.columns)
    assert found.dtypes == want.dtypes
    assert sorted(map(str, found.collect())) == sorted(map(str, want.collect()))
    twice = stack.unionByName(stack.limit(1))
    with pytest.raises(Exception, match="holds a cell twice"):
        by_layer(to_segments(twice, "hours", width=4), "hours").collect()
    plan = plan_of(found)
    assert "Exchange" not in plan[: plan.index("Generate")]
