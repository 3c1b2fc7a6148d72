"""Connected areas against a flood fill, boundaries, rings and features."""

import json
import time
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from access_engine.operators import boundary as S
from access_engine.operators.grid import Grid
from access_engine.operators.regions import connected_components, connected_runs, polygonize
from access_engine.operators.rings import assemble_features, chained, corners, rings
from access_engine.operators.spans import burn, rasterise
from access_engine.sources import features as V


def flood(classes):
    """Smallest cell number of the component of every cell, by depth-first search."""
    zone, ncols = {}, 1 + max(c for _, c in classes)
    for start in sorted(classes):
        if start in zone:
            continue
        todo, zone[start] = [start], start[0] * ncols + start[1]
        while todo:
            r, c = todo.pop()
            for at in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                if at in classes and at not in zone and classes[at] == classes[(r, c)]:
                    zone[at] = zone[start]
                    todo.append(at)
    return zone


def raster(kind, nrows, ncols):
    rng = random.Random(11)
    out = {}
    for r in range(nrows):
        for c in range(ncols):
            if kind == "noise":
                out[r, c] = rng.randint(1, 2)
            elif kind == "smooth":
                out[r, c] = 1 + int((r - 40) ** 2 + (c - 50) ** 2 > 900)
            elif kind == "one class":
                out[r, c] = 1
            elif kind == "serpentine":
                # one corridor winding through the whole raster
                wall = r % 2 == 1 and c != (ncols - 1 if r % 4 == 1 else 0)
                out[r, c] = 2 if wall else 1
            elif kind == "holes in the data" and rng.random() < 0.7:
                out[r, c] = 1
    return out


@pytest.mark.parametrize("kind", ["noise", "smooth", "one class", "serpentine", "holes in the data"])
def test_polygonize(spark, kind):
    nrows, ncols = 61, 83
    classes = raster(kind, nrows, ncols)
    classes[nrows - 1, ncols - 1] = classes.get((nrows - 1, ncols - 1), 1)
    grid = Grid(0.0, float(nrows), 1.0, 1.0, ncols, nrows)
    rows = [(d, r, c, k) for (r, c), k in classes.items() for d in (0, 1)]
    cells = spark.createDataFrame(rows, "layer int, row_no int, col_no int, band int")
    got = {
        (r.layer, r.row_no, r.col_no): r.zone_id
        for r in polygonize(cells, grid, "band", ["layer"], tile=16).collect()
    }
    want = flood(classes)
    assert got == {(d, *at): z for at, z in want.items() for d in (0, 1)}


@pytest.mark.parametrize("kind", ["noise", "serpentine"])
def test_runs_of_many_blocks(spark, kind):
    """Tasks that unite a few runs at a time part no tile; runs come back cut at strips and nothing else."""
    classes = raster(kind, 33, 47)
    grid = Grid(0.0, 33.0, 1.0, 1.0, 47, 33)
    cells = spark.createDataFrame([(r, c, k) for (r, c), k in classes.items()], "row_no int, col_no int, band int")
    runs = connected_runs(S.cells_to_spans(cells, ["band"]), grid, "band", tile=8, block=20).collect()
    want = flood(classes)
    assert {(r.row_no, c): r.zone_id for r in runs for c in range(r.c0, r.c1)} == want
    assert sum(r.c1 - r.c0 for r in runs) == len(classes)
    ends = {(r.row_no, r.c1): r.zone_id for r in runs}
    assert all(r.c0 % 8 == 0 for r in runs if ends.get((r.row_no, r.c0)) == r.zone_id)


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(0, 3000)]
    star = [(10_000, 10_001 + i) for i in range(5000)]
    pairs = spark.createDataFrame(chain + star, "a long, b long")
    rows = connected_components(pairs).collect()
    assert {r.node: r.component for r in rows} == {
        **{i: 0 for i in range(1, 3001)},
        **{10_001 + i: 10_000 for i in range(5000)},
    }


def test_components_without_pairs(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_shared_edges_vanish(spark):
    squares = [(0, 0), (1, 0), (0, 1), (1, 1)]
    rows = []
    for i, (x, y) in enumerate(squares):
        ring = [(x, y), (x + 1, y), (x + 1, y + 1), (x, y + 1)]
        rows += [("p", *map(float, a), *map(float, b)) for a, b in zip(ring, ring[1:] + ring[:1])]
    df = spark.createDataFrame(rows, "k string, x1 double, y1 double, x2 double, y2 double")
    assert S.dissolve_edges(df, ["k"]).count() == 8


PATTERN = [
    "..........",
    ".####.....",
    ".#..#.##..",
    ".#..#.##..",
    ".####....#",
    ".....#..#.",
    "......#...",
]


def pattern_cells(spark, pattern=PATTERN):
    rows = [(7, r, c) for r, line in enumerate(pattern) for c, ch in enumerate(line) if ch == "#"]
    return spark.createDataFrame(rows, "id int, row_no int, col_no int"), rows


def test_span_boundary_length(spark):
    cells, rows = pattern_cells(spark)
    spans = S.cells_to_spans(cells, ["id"])
    segments = S.span_boundary(spans, ["id"]).collect()
    have = {(r, c) for _, r, c in rows}
    edges = sum((r + a, c + b) not in have for r, c in have for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0)))
    assert sum(s.c1 - s.c0 for s in segments) == edges


def test_span_boundary_over_block_borders(spark):
    """Outlines settled in blocks of rows: each edge once, every segment as long as it can be, spans twice cancel."""
    rng = random.Random(3)
    held = {(k, r, c) for k in (None, "a", "b") for r in range(23) for c in range(9) if rng.random() < 0.6}
    held |= {("v", r, 3) for r in range(5, 40)}
    cells = spark.createDataFrame(sorted(held, key=str), "k string, row_no int, col_no int")
    spans = S.cells_to_spans(cells, ["k"])
    twice = spans.unionAll(spans.where("k = 'b' and row_no between 3 and 8"))
    held -= {(k, r, c) for k, r, c in held if k == "b" and 3 <= r <= 8}
    edges = {}
    for k, r, c in held:
        for side, line, at in (("h", r, c), ("h", r + 1, c), ("v", c, r), ("v", c + 1, r)):
            edges.setdefault((k, side, line), set()).symmetric_difference_update({at})
    want = []
    for (k, side, line), places in edges.items():
        for at in sorted(places):
            if at - 1 not in places:
                want.append((k, side, line, at, next(e for e in range(at + 1, at + 50) if e not in places)))
    for height, most in ((4, 7), (1, 1), (128, 1000)):
        found = S.span_boundary(twice, ["k"], height, most)
        assert [d for _, d in found.dtypes[1:]] == ["string", "int", "int", "int"]
        assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
    assert S.span_boundary(spans.where("row_no < 0").drop("k"), []).count() == 0


def feature_grid():
    return Grid(100.0, 50.0, 2.0, 3.0, 10, 7)


def read_back(spark, tmp_path, features):
    path = str(tmp_path / "out")
    V.write_geojson(features, path, ["id"], 32644)
    kinds = T.StructType([features.schema["id"]])
    return V.read_geojson(spark, path, kinds)


def test_features_keep_their_cells(spark, tmp_path):
    """Hole, several parts, corner contact: one feature that covers the same cells."""
    cells, rows = pattern_cells(spark)
    grid = feature_grid()
    features = assemble_features(S.cells_to_spans(cells, ["id"]), grid, ["id"])
    back = read_back(spark, tmp_path, features).cache()
    (only,) = back.collect()
    sizes = sorted(len(part) for part in only.coordinates)
    assert only.srid == 32644 and sizes == [1, 1, 1, 1, 1, 2]
    area = S.signed_area(V.feature_edges(back, ["id"]), ["id"]).first().area
    assert area == pytest.approx(len(rows) * 6.0)
    drawn = burn(rasterise(V.feature_edges(back, ["id"]), grid, ["id"])).collect()
    assert sorted((r.id, r.row_no, r.col_no) for r in drawn) == sorted(rows)
    joined = V.ring_edges(V.ring_vertices(back, ["id"]), ["id"])
    assert joined.count() == V.feature_edges(back, ["id"]).count()


def test_holes_within_islands_within_holes(spark):
    pattern = ["#########", "#.......#", "#.#####.#", "#.#.#.#.#", "#.#####.#", "#.......#", "#########"]
    cells, _ = pattern_cells(spark, pattern)
    text = assemble_features(S.cells_to_spans(cells, ["id"]), feature_grid(), ["id"]).first().geometry
    assert sorted(len(part) for part in json.loads(text)["coordinates"]) == [2, 3]


def plain_rings(outline):
    """Rings of directed edges, each as its corners from the smallest on, by following edges one by one."""
    leaving, out = {}, []
    for px, py, qx, qy in outline:
        leaving.setdefault((px, py), []).append((qx, qy))
    while leaving:
        start = at = min(leaving)
        way, points = None, []
        while True:
            options = leaving[at]
            turn = lambda q: 0 if way is None else way[0] * (q[1] - at[1]) - way[1] * (q[0] - at[0])
            to = min(options, key=turn)
            options.remove(to)
            if not options:
                del leaving[at]
            new = ((to[0] > at[0]) - (to[0] < at[0]), (to[1] > at[1]) - (to[1] < at[1]))
            if new != way:
                points.append(at)
            at, way = to, new
            if at == start and (at not in leaving or min(leaving[at], key=turn) is None or len(points) > 2):
                break
        ways = [(b[0] - a[0], b[1] - a[1]) for a, b in zip(points, points[1:] + points[:1])]
        straight = [w[0] * v[0] > 0 or w[1] * v[1] > 0 for w, v in zip(ways[-1:] + ways[:-1], ways)]
        points = [p for p, s in zip(points, straight) if not s]
        k = points.index(min(points))
        out.append(points[k:] + points[:k])
    return sorted(out)


@pytest.mark.parametrize("block", [3, 40, 1 << 18])
def test_rings_ranked_over_many_tasks_equal_plain_chaining(spark, block):
    """A feature whose corners lie in many blocks: a serpentine of one long ring, noise, and a second feature."""
    nrows, ncols = 41, 37
    cells = [(1, r, c) for (r, c), k in raster("serpentine", nrows, ncols).items() if k == 1]
    cells += [(2, r, c) for (r, c), k in raster("one class", 5, 6).items()]
    grid = Grid(0.0, float(nrows), 1.0, 1.0, ncols, nrows)
    spans = S.cells_to_spans(spark.createDataFrame(cells, "feature long, row_no int, col_no int"), ["feature"])
    outline = S.directed_outline(spans, ["feature"])
    found = {}
    for r in rings(outline.repartition(7), grid, block).collect():
        point = r.id // 4
        found.setdefault((r.feature, r.ring), {})[r.nth] = (point % (ncols + 1), point // (ncols + 1))
    assert all(sorted(ring) == list(range(len(ring))) for ring in found.values())
    for feature in (1, 2):
        got = [[ring[k] for k in range(len(ring))] for (f, _), ring in found.items() if f == feature]
        got = [ring[ring.index(min(ring)) :] + ring[: ring.index(min(ring))] for ring in got]
        edges = [(e.px, e.py, e.qx, e.qy) for e in outline.where(f"feature = {feature}").collect()]
        assert sorted(got) == plain_rings(edges)


@pytest.mark.parametrize("block", [5, 1 << 18])
def test_features_of_noise_keep_their_cells(spark, tmp_path, block):
    """Holes in areas in holes, corner contacts, features without a key: what is drawn covers the same cells."""
    rng = random.Random(3)
    rows = [(i, r, c) for i in (1, 2) for r in range(7) for c in range(10) if rng.random() < 0.6]
    cells = spark.createDataFrame(rows, "id int, row_no int, col_no int")
    features = assemble_features(S.cells_to_spans(cells, ["id"]), feature_grid(), ["id"], block)
    back = read_back(spark, tmp_path, features).cache()
    drawn = burn(rasterise(V.feature_edges(back, ["id"]), feature_grid(), ["id"])).collect()
    assert sorted((r.id, r.row_no, r.col_no) for r in drawn) == sorted(rows)
    for feature in back.collect():  # each part is one connected area with its own holes
        own = {(r, c): 1 for i, r, c in rows if i == feature.id}
        assert len(feature.coordinates) == len(set(flood(own).values()))
    nameless = cells.select(F.lit(None).cast("int").alias("id"), "row_no", "col_no").distinct()
    assert assemble_features(S.cells_to_spans(nameless, ["id"]), feature_grid(), ["id"], block).count() == 1
    assert assemble_features(S.cells_to_spans(cells.limit(0), ["id"]), feature_grid(), ["id"], block).count() == 0


def test_no_task_chains_more_than_its_share(spark):
    """A sieve has over 100,000 outline edges, nearly all of them holes': its corners go to many partitions."""
    cells = spark.range(600 * 640).selectExpr("7L as feature", "int(id / 640) as row_no", "int(id % 640) as col_no")
    spans = S.cells_to_spans(cells.where("row_no % 3 < 2 or col_no % 3 < 2"), ["feature"])
    grid = Grid(0.0, 600.0, 1.0, 1.0, 640, 600)
    points = corners(S.directed_outline(spans, ["feature"]), grid)
    merged = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(merged, "false")  # the optimizer would merge what is small here
    parts = [r["count"] for r in points.groupBy(F.spark_partition_id()).count().collect()]
    spark.conf.unset(merged)
    assert sum(parts) > 100_000 and max(parts) < sum(parts) / 4
    start = time.time()
    text = assemble_features(spans, grid, ["feature"]).first().geometry
    assert time.time() - start < 60
    shape = json.loads(text)
    assert len(shape["coordinates"]) == 1 and len(shape["coordinates"][0]) > 40_000
    assert all(ring[0] == ring[-1] and len(ring) == 5 for ring in shape["coordinates"][0][1:])


def test_chains_start_where_something_leads_in():
    chain, nth, last = chained(np.array([1, 1, 1, 1, 2, 2]), np.array([4, 8, 12, 16, 4, 8]), np.array([8, 12, 99, 4, 8, 4]))
    assert chain.tolist() == [16, 16, 16, 16, 4, 4] and nth.tolist() == [1, 2, 3, 0, 0, 1]
    assert last.tolist() == [False, False, True, False, False, True]


def test_rings_are_closed(spark, tmp_path):
    cells, _ = pattern_cells(spark)
    text = assemble_features(S.cells_to_spans(cells, ["id"]), feature_grid(), ["id"]).first()
    shape = json.loads(text.geometry)
    assert shape["type"] == "MultiPolygon"
    assert all(ring[0] == ring[-1] for part in shape["coordinates"] for ring in part)
