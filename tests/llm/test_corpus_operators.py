"""SimHash, decontamination, mixing, sharding, search and the pipeline against brute force and on odd input."""

import math
import random
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from access_engine.llm import decontaminate, mixing, queries, search, sharding, simhash
from access_engine.llm.components import components
from checks.compare import connect, difference

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, size long, id long, key string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns that clash with those the operators make."""
    rows = [
        (1, "a plain text of some words", "en", "s", 1, "r", 1, 7, "k"),
        (1, "a plain text of some words", "en", "s", 1, "r", 1, 7, "k"),
        (2, None, None, None, None, None, None, None, None),
        (3, "", "en", "s", 0, "r", 2, 7, "k"),
        (None, "no id at all", "en", None, 2, "r", 3, 7, "k"),
        (4, "many different words " * 20_000, "en", "t", 3, "r", 4, 7, "k"),
        (5, " \t\n ", "en", "t", 3, "r", 4, 7, "k"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.mark.parametrize("name", [n for n in queries.ORACLE if n != "op3_chat"] + ["op3_chat"])
def test_equals_sql(spark, name):
    assert difference(spark, connect(FOLDER), queries.QUERIES[name], queries.ORACLE[name], FOLDER) is None


# SimHash


def plain_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text).encode().split()]
    shingles = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum((sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) << b for b in range(64))


def groups(pairs, nodes):
    name = {n: n for n in nodes}
    for _ in nodes:
        changed = False
        for a, b in pairs:
            low = min(name[a], name[b])
            changed |= name[a] != low or name[b] != low
            name[a] = name[b] = low
        if not changed:
            return name
    return name


def test_fingerprints_are_those_of_the_definition(spark, docs):
    for t in ("", "One", "One TWO", "one two three", "a b c d " * 50, "É è\x0bB c"):
        assert simhash.fingerprint(t.encode()) == plain_fingerprint(t)
    found = {r.doc_id: r.fp % (1 << 64) for r in simhash.fingerprints(docs).collect()}
    assert all(found[r.doc_id] == plain_fingerprint(r.text) for r in docs.collect())


def test_every_close_pair_agrees_on_a_key():
    rng = random.Random(1)
    for _ in range(2000):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), 3):
            b ^= 1 << bit
        agreeing = [k for k, m in enumerate(simhash.COARSE) if (a ^ b) & m == 0]
        assert agreeing
        assert all(any((a ^ b) & m == 0 for m in simhash.FINE[k]) for k in agreeing)
    assert all(m.bit_count() >= 49 for fine in simhash.FINE for m in fine)


@pytest.mark.parametrize("split", [simhash.SPLIT, 4])
def test_links_connect_what_is_close(spark, split):
    rng = random.Random(2)
    fps = {0, 1}
    for _ in range(40):
        fp = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            fps.add(fp)
            for bit in rng.sample(range(64), rng.randint(1, 4)):
                fp ^= 1 << bit
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    close = [(a, b) for k, a in enumerate(signed) for b in signed[:k] if ((a ^ b) % (1 << 64)).bit_count() <= 3]
    frame = spark.createDataFrame([(f,) for f in signed], "fp long").repartition(5)
    found = [(r.a, r.b) for r in simhash.links(frame, split).collect()]
    assert all(((a ^ b) % (1 << 64)).bit_count() <= 3 for a, b in found)
    assert groups(found, signed) == groups(close, signed)


def test_pivot_coordinates_bound_the_distance():
    fp = np.array([random.Random(k).getrandbits(64) for k in range(300)], np.uint64)
    fp[1::2] = fp[::2] ^ np.uint64(0b1011)
    a, b = (g.ravel() for g in np.meshgrid(np.arange(300), np.arange(300)))
    found = simhash.survivors(fp, a, b, simhash.pivot_table(fp))
    assert set(found.tolist()) == set(np.flatnonzero(np.bitwise_count(fp[a] ^ fp[b]) <= 3).tolist())


def test_components(spark):
    rng = random.Random(4)
    edges = [(k, k + 1) for k in range(100, 140)] + [(200, k) for k in range(201, 230)] + [(5, 5)]
    edges += [(rng.randint(300, 400), rng.randint(300, 400)) for _ in range(60)]
    nodes = sorted({n for e in edges for n in e if e[0] != e[1]})
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {n: r for n, r in groups(edges, nodes + [5]).items() if n != 5}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_odd_rows(odd):
    found = simhash.near_duplicates(odd).collect()
    assert len(found) == 7
    zero = {r.doc_id: r.component_id for r in found if r.fp == 0}
    assert zero == {2: 2, 3: 2, 5: 2}
    kept = simhash.first_of_each(odd)
    assert kept.columns == odd.columns and kept.exceptAll(odd).count() == 0
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 4]
    assert simhash.near_duplicates(odd.limit(0)).count() == simhash.first_of_each(odd.limit(0)).count() == 0


def test_rows_with_shared_or_no_ids_are_told_apart(spark):
    a, b, c = (" ".join(f"{letter}{k}" for k in range(30)) for letter in "abc")
    rows = [(1, a), (2, b), (2, a), (2, b), (None, a), (None, c), (None, c), (3, b.upper())]
    kept = simhash.first_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(((r.doc_id or 0, r.text) for r in kept)) == [(0, c), (1, a), (2, b)]


# Decontamination


def test_contained_items_odd_rows(spark, odd):
    items = [(1, "A plain text of some words"), (2, None), (3, " "), (4, "some words"), (5, "different words many different words many"), (4, "some words")]
    benchmark = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, row string")
    found = sorted((r.doc_id, r.item_id, r.containment) for r in decontaminate.contained_items(odd, benchmark).collect())
    assert found == [(1, 1, 1.0)] * 2 + [(1, 4, 1.0)] * 4 + [(4, 5, 1.0)]
    kept = decontaminate.without_items(odd, benchmark)
    assert kept.columns == odd.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 2, 3, 5]
    assert decontaminate.without_items(odd, benchmark.limit(0)).count() == 7
    assert decontaminate.contained_items(odd.limit(0), benchmark).count() == 0


def test_sketches_miss_nothing(monkeypatch):
    rng = random.Random(3)
    items = [(k, " ".join(rng.choice("abcdefg") * rng.randint(1, 3) for _ in range(rng.randint(1, 40))).encode()) for k in range(60)]
    sketches = decontaminate.Sketches(items, 0.8)
    texts = []
    for _ in range(200):
        words = rng.choice(items)[1].split()
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(len(words))] = b"new"
        texts.append(b" ".join([b"x"] * rng.randint(0, 9) + words + [b"y"] * rng.randint(0, 9)))
    offsets = np.cumsum([0, *map(len, texts)])
    near = sketches.candidates(np.frombuffer(b"".join(texts), np.uint8), offsets)
    every = [i for i, *_ in ((k, v) for k, v in enumerate(sketches.items))]
    for k, t in enumerate(texts):
        some = [i for text, i in near if text == k]
        assert sorted(sketches.verified(t, some)) == sorted(sketches.verified(t, every))


def test_more_items_make_more_passes(spark, docs, monkeypatch):
    benchmark = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    whole = sorted(map(tuple, decontaminate.contained_items(docs, benchmark).collect()))
    monkeypatch.setattr(decontaminate, "ITEMS", 15)
    assert sorted(map(tuple, decontaminate.contained_items(docs, benchmark).collect())) == whole and whole


# Mixing


def test_targets_fill_up(spark):
    sizes = {None: 5, "a": 100, "b": 7, "c": 900, "d": 0, "e": 40}
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    found = {r.source: r.target for r in mixing.targets(frame, mixing.WEIGHTS, 1.5, 2.0).collect()}
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(order)}
    target, open_, left = {}, set(order), 1.5 * sum(sizes.values())
    while open_:  # share, stop who is above, share the rest anew
        share = {s: left * weight[s] / sum(weight[t] for t in open_) for s in open_}
        above = {s for s in open_ if share[s] >= 2 * sizes[s]}
        for s in above or open_:
            target[s] = 2.0 * sizes[s] if above else share[s]
            left -= target[s]
        open_ -= above or open_
    assert found == pytest.approx(target)


def test_mix_odd_rows(odd):
    found = mixing.taken(odd).collect()
    assert len(found) == 7 and all(0 <= r.taken <= 2 * r.size for r in found)
    assert sorted(map(str, found)) == sorted(map(str, mixing.taken(odd.repartition(3)).collect()))
    copies = mixing.copied(odd)
    assert copies.columns == odd.columns and copies.select("doc_id", "text").distinct().exceptAll(odd.select("doc_id", "text").distinct()).count() == 0
    assert mixing.taken(odd.limit(0)).count() == mixing.copied(odd.limit(0)).count() == 0


def test_mix_misses_by_half_a_document(docs):
    rows = mixing.mixed(docs, columns=["doc_id", "source"]).select("row.source", "size", "target", "copies").collect()
    taken, target, largest = defaultdict(int), {}, defaultdict(int)
    for r in rows:
        taken[r.source] += r.size * r.copies
        target[r.source] = r.target
        largest[r.source] = max(largest[r.source], r.size)
    assert all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6 for s in taken)


def test_chances_follow_sizes(spark):
    """Many sources of the same sizes are many draws: how often a size is taken is its chance."""
    sizes = [1, 2, 3, 5, 8, 13, 21, 34, 100] + list(range(4, 44, 2))
    rows = [(r * 100 + k, f"s{r:04d}", "w " * size) for r in range(900) for k, size in enumerate(sizes)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    found = mixing.mixed(docs, weights=(1.0,), total=1.5, columns=["doc_id"]).select("row.doc_id", "size", "copies").collect()
    rest, open_ = 0.5 * sum(sizes), sorted(sizes)
    while open_ and open_[-1] * rest >= sum(s * s for s in open_):
        rest -= open_.pop()
    chance = {s: min(1.0, s * rest / sum(x * x for x in open_)) for s in set(sizes)}
    assert chance[100] == 1.0 and 0.01 < chance[1] < 0.1
    taken = defaultdict(list)
    for r in found:
        taken[r.size].append(r.copies - 1)
    for size, copies in taken.items():
        p, many = chance[size], len(copies)
        assert set(copies) <= {0, 1}
        # the sum of the words is fixed, which moves a chance a little besides the noise of the draws
        assert abs(np.mean(copies) - p) < 0.03 + 4 * math.sqrt(p * (1 - p) / many), (size, p, np.mean(copies))
    frequent = [np.mean(taken[s]) for s in (2, 10, 20, 34, 100)]
    assert frequent == sorted(frequent) and frequent[-1] == 1.0


def test_alike_rows_are_taken_in_part(spark):
    """Rows that nothing tells apart: as many of them are taken as the target needs."""
    rows = [(None, "s", "one two three")] * 1000 + [(k, "t", "x " * (k % 7)) for k in range(50)]
    found = mixing.mixed(spark.createDataFrame(rows, "doc_id long, source string, text string"), weights=(1.0, 1.0), total=1.3)
    words = {r.source: (r.words, r.target, r.most) for r in found.groupBy("row.source").agg(
        F.sum(F.col("size") * F.col("copies")).alias("words"), F.max("target").alias("target"), F.max("size").alias("most")).collect()}
    assert all(abs(got - target) <= most / 2 for got, target, most in words.values()) and found.count() == 1050


# Sharding


@pytest.mark.parametrize("ranges", [64, sharding.RANGES])
def test_shards_are_even_and_slots_gapless(docs, ranges):
    rows, total = defaultdict(list), 0
    for r in sharding.sharded(docs, shards=5, ranges=ranges).collect():
        rows[r.shard].append(r)
    texts = {r.doc_id: r.text.encode() for r in docs.collect()}
    largest = max(len(t) + 1 for t in texts.values())
    sizes = {s: sum(r.size for r in some) for s, some in rows.items()}
    assert max(sizes.values()) - min(sizes.values()) <= 2 * largest
    assert all(sorted(r.slot for r in some) == list(range(len(some))) for some in rows.values())
    assert sorted(r.doc_id for some in rows.values() for r in some) == sorted(texts)
    assert all(r.text_crc32 == zlib.crc32(texts[r.doc_id]) and r.size == len(texts[r.doc_id]) + 1 for some in rows.values() for r in some)


def test_sharding_splits_one_hot_text(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 1500, "same text").otherwise(F.col("id").cast("string")).alias("text"))
    sizes = sharding.sharded(docs, ranges=256).groupBy("shard").agg(F.sum("size").alias("size")).toPandas()["size"]
    assert len(sizes) == 16 and sizes.max() - sizes.min() <= 20


@pytest.mark.parametrize("ranges, most, pieces", [(8, 20, 5), (64, 1, 32), (1, 30, 64)])
def test_subdivided_ranges_change_nothing(spark, docs, ranges, most, pieces):
    """Few ranges, all of them or some overfull, one text that is most of the rows, ids that are null or below zero."""
    hot = spark.range(-150, 150).select(F.when(F.col("id") != 3, F.col("id")).alias("doc_id"), F.lit("same text").alias("text"))
    rows = docs.select("doc_id", "text").unionByName(hot)
    columns = ["doc_id", "size", "text_crc32", "shard", "slot"]
    plain = sorted(map(tuple, sharding.sharded(rows).select(columns).collect()), key=str)
    cut = sorted(map(tuple, sharding.sharded(rows, ranges=ranges, most=most, pieces=pieces).select(columns).collect()), key=str)
    assert cut == plain and len(plain) == 500


def test_sharding_odd_rows(odd):
    found = sharding.sharded(odd).collect()
    assert len(found) == 7 and {(r.size, r.text_crc32) for r in found if r.doc_id in (2, 3)} == {(1, 0)}
    assert sharding.sharded(odd.limit(0)).count() == 0


# Search


def plain_search(queries, docs, k):
    """BM25 of every document for every query; rows are (doc_id, text)."""
    words = [Counter("".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()) for _, t in docs]
    average = sum(sum(w.values()) for w in words) / max(1, len(docs)) or 1.0
    frequency = Counter(w for own in words for w in own)
    out = []
    for query_id, text in queries:
        asked = set("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split())
        scores = []
        for (doc_id, _), own in zip(docs, words, strict=True):
            if doc_id is None or not asked & own.keys():
                continue
            length = 1.2 * (0.25 + 0.75 * sum(own.values()) / average)
            weight = {w: math.log1p((len(docs) - frequency[w] + 0.5) / (frequency[w] + 0.5)) for w in asked & own.keys()}
            scores.append((-round(sum(v * own[w] * 2.2 / (own[w] + length) for w, v in weight.items()), 9), doc_id))
        out += [(query_id, rank, doc_id, -score) for rank, (score, doc_id) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def found_rows(frame):
    return sorted((r.query_id, r.rank, r.doc_id, round(r.score, 9)) for r in frame.collect())


@pytest.mark.parametrize("shard_bytes,block_docs,many", [(20_000, 3, 4), (1, 64, 4096), (search.SHARD_BYTES, 1, 3)])
def test_search_over_many_shards_and_query_blocks(spark, docs, shard_bytes, block_docs, many):
    asked = docs.where("doc_id % 20 = 0")
    found = search.top_k(asked.repartition(3), docs.repartition(4), 4, shard_bytes, block_docs, many)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    wanted = plain_search([r for r in rows if r[0] % 20 == 0], rows, 4)
    assert [r[:3] for r in found_rows(found)] == [r[:3] for r in wanted] and len(wanted) == 40
    assert [r[3] for r in found_rows(found)] == pytest.approx([r[3] for r in wanted])
    if shard_bytes == 20_000:
        assert search.build_index(docs.repartition(4), shard_bytes).count() > 15


@pytest.mark.parametrize("rows", [
    [(1, "a"), (2, "b"), (3, ""), (4, None), (5, "  ")],  # under one word on average
    [(1, "a b"), (2, "a c"), (None, "a a a b"), (None, "d"), (3, "d")],  # rows without doc_id count
    [(1, "a b"), (1, "a b"), (2, "A B"), (3, "b"), (4, "a b x y z")],  # repeated rows and ties
    [(k, "w " * (k % 5) + "x" * (k % 3)) for k in range(40)],
])
def test_search_counts_all_documents(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for shard_bytes in (1, 10, search.SHARD_BYTES):
        found = found_rows(search.top_k(frame, frame.repartition(3), 3, shard_bytes, 2))
        wanted = plain_search([r for r in rows if r[0] is not None], rows, 3)
        assert [r[:3] for r in found] == [r[:3] for r in wanted]
        assert [r[3] for r in found] == pytest.approx([r[3] for r in wanted])


def test_search_passes_over_blocks(docs):
    """Blocks that can't hold one of the best are not looked into, and that changes no result."""
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    batch = pa.RecordBatch.from_pydict({"doc_id": [d for d, _ in texts], "text": [t for _, t in texts]})
    (row,) = next(search._shard_rows(iter([batch]), search.SHARD_BYTES)).to_pylist()
    shard, queries = search.Shard(row, row["total"] / row["n"], 4), []
    for _, text in texts[::20]:
        _, words, _, _ = search._terms(pa.array([text]))
        frequency = np.diff(shard.starts)[np.searchsorted(shard.words, words)]
        queries.append((words, np.log1p((len(texts) - frequency + 0.5) / (frequency + 0.5))))
    found = list(shard.search(queries, 5, np.zeros(len(queries))))
    known = np.array([scores[-1] for _, scores in found])
    shard.looked = shard.passed = 0
    again = list(shard.search(queries, 5, known))
    assert all(a.tolist() == c.tolist() and b.tolist() == d.tolist() for (a, b), (c, d) in zip(found, again, strict=True))
    assert shard.passed > shard.looked


def test_search_odd_rows(odd):
    found = {(r.query_id, r.rank, r.doc_id) for r in search.top_k(odd, odd, 3).collect()}
    assert {f for f in found if f[0] == 4} == {(4, 1, 4), (4, 2, 1), (4, 3, 1)}
    assert {f[0] for f in found} == {1, 4}
    assert search.top_k(odd, odd.limit(0)).count() == search.top_k(odd.limit(0), odd).count() == 0


# Pipeline


def test_pipeline(spark, docs):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    benchmark = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    held, kept = docs, []
    for _, stage in corpus_pipeline.STAGES:
        held = stage(spark, held, FOLDER)
        kept.append({r.doc_id for r in held.select("doc_id").collect()})
    good, single, clean, mixed, sharded = kept
    assert all(d in good for d, q in labels.items() if q == 1)
    assert sum(d in good for d, q in labels.items() if q == 0) <= 3
    known = {r.doc_id: r.text for r in docs.collect() if r.doc_id in good}
    fps = {d: plain_fingerprint(t) for d, t in known.items()}
    close = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 3]
    assert single == {d for d, root in groups(close, list(fps)).items() if d == root}
    dirty = {r.doc_id for r in decontaminate.contained_items(docs, benchmark).collect()}
    assert clean == single - dirty and dirty & single
    assert mixed <= clean and sharded == mixed
    whole = corpus_pipeline.run(spark, FOLDER)
    assert whole.columns == held.columns and sorted(map(str, whole.collect())) == sorted(map(str, held.collect()))


def test_pipeline_stages_keep_the_columns(spark, odd):
    frame = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, FOLDER)
        assert frame.columns == odd.columns, name
    assert corpus_pipeline.STAGES[-1][1](spark, frame, FOLDER).count() == frame.count()
