"""Periodic runs, licence scans and the prefix trie against brute force and on odd input."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from access_engine.llm import licenses, periods, trie

FOLDER = "/root/testdata/sf0.001"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns that clash with those the operators make."""
    rows = [
        (1, "a b a b a b a b , all rights reserved", "r", 1),
        (1, "a b a b a b a b , all rights reserved", "r", 1),
        (2, None, None, None),
        (3, "", "r", 2),
        (None, "no no no no no no ID", "r", 3),
        (4, "word " * 60_000 + "é", "r", 4),
        (5, " \t\n ", "r", 4),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, runs string, n_words long")


# Periodic runs


def plain_runs(words):
    """Runs by comparing every word with the one each period on, smallest periods told by trying all smaller ones."""
    number, out = {}, []
    ids = np.array([number.setdefault(w, len(number)) for w in words])
    for q in range(1, len(words) // 4 + 1):
        step = np.diff(np.concatenate([[0], (ids[:-q] == ids[q:]).astype(int), [0]]))
        for s, e in zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True):
            n = e - s + q
            if n >= max(6, 4 * q) and not any((ids[s : s + n - d] == ids[s + d : s + n]).all() for d in range(1, q)):
                out.append((s, n, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_equal_brute_force():
    rng = random.Random(1)
    for _ in range(800):
        letters, texts = [b"a", b"b", b"c"][: rng.randint(1, 3)], []
        for _ in range(rng.randint(1, 4)):
            words = [rng.choice(letters) for _ in range(rng.randint(0, 30))]
            if rng.random() < 0.5:
                unit = [rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(rng.randint(1, 70))]
                words += (unit * rng.randint(2, 8))[: rng.randint(1, 400)] + [rng.choice(letters) for _ in range(9)]
            texts.append(words)
        bounds = np.cumsum([0, *map(len, texts)])
        wanted = [(s + int(bounds[t]), n, q) for t, words in enumerate(texts) for s, n, q in plain_runs(words)]
        assert periods.runs_of([w for words in texts for w in words], bounds) == wanted


def test_words_of_one_hash_are_told_apart(monkeypatch):
    words = [b"a", b"b"] * 4 + [b"c", b"d", b"e", b"f"]
    monkeypatch.setattr(periods, "hash", lambda w: 7, raising=False)
    assert periods.runs_of(words, np.array([0, len(words)])) == [(0, 8, 2)]


def test_levels_leave_no_period_out():
    found = list(periods.levels(100_000))
    assert all(a[1] == b[0] for a, b in zip(found, found[1:], strict=False)) and found[0][0] == 0
    assert 4 * (found[-1][1] + 1) > 100_000
    assert all(periods.overlap(q) >= k >= q for low, k in found for q in (low + 1, low + 2, k) if q <= k)


def plain_periods(doc_id, text):
    words = SPACE.findall(text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        a, g = (h // 10) % n, h // 10
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs, gone = plain_runs(words), set()
    for s, length, q in runs:
        gone.update(range(s + q, s + length))
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (
        *(doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2]),
        sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)),
        sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def test_query_of_periods_equals_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    found = {r.doc_id: tuple(r) for r in periods.query(spark, FOLDER).collect()}
    assert found == {d: plain_periods(d, t) for d, t in texts.items()}
    assert sum(r[1] > 0 for r in found.values()) > 5


def test_periods_odd_rows(odd):
    found = periods.periodic_runs(odd).collect()
    runs = {r.doc_id: [tuple(x) for x in r.runs] for r in found}
    assert runs == {1: [(0, 8, 2)], 2: [], 3: [], None: [(0, 6, 1)], 4: [(0, 60_000, 1)], 5: []}
    text = {r.doc_id: r.collapsed for r in found}
    assert len(found) == 7 and text[1] == "a b , all rights reserved" and text[4] == "word é" and text[5] == text[2] == ""
    assert periods.digests(periods.periodic_runs(periods.planted(odd))).count() == 7
    assert periods.periodic_runs(odd.limit(0)).count() == periods.planted(odd.limit(0)).count() == 0


# Licences


def test_matching_statistics_equal_brute_force():
    rng = random.Random(2)
    for _ in range(300):
        known = [[rng.randint(0, 3) for _ in range(rng.randint(1, 12))] for _ in range(rng.randint(1, 4))]
        pieces = defaultdict(set)
        for n, s in enumerate(known):
            for a in range(len(s)):
                for b in range(a + 1, len(s) + 1):
                    pieces[tuple(s[a:b])].add((n, b))
        automaton, words = licenses.Automaton(known), [rng.randint(0, 4) for _ in range(40)]
        for k, (state, length) in enumerate(zip(*automaton.statistics(words), strict=True)):
            assert length == max([m for m in range(1, k + 2) if tuple(words[k + 1 - m : k + 1]) in pieces], default=0)
            if length:
                assert set(automaton.ends[state]) == pieces[tuple(words[k + 1 - length : k + 1])]


def plain_places(text):
    words = licenses.words_of((text or "").encode())
    assert words == [w.encode() for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]
    return len(words), sorted(
        (label, k, k + len(p.split())) for label, p in licenses.PHRASES for k in range(len(words)) if words[k : k + len(p.split())] == p.encode().split()
    )


def test_places_equal_plain_search(spark):
    rng = random.Random(3)
    vocabulary = "cc by general public license all rights reserved gnu the v1.0 é licensed under".split()
    rows = [(k, rng.choice([" ", "-", "\n"]).join(rng.choices(vocabulary, k=rng.randint(0, 60))).title()) for k in range(400)]
    rows += [(1000 + r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    found = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    wanted = {d: plain_places(t) for d, t in rows}
    assert {r.doc_id: (r.n_words, sorted(map(tuple, r.places))) for r in found} == wanted
    assert sum(len(places) for _, places in wanted.values()) > 40


def test_chains_cover_templates_with_gaps(spark):
    notices = {label: text for label, text in licenses.TEMPLATES}
    mit, bsd = (notices[k].split() for k in ("mit", "bsd"))
    changed = mit[:20] + ["really"] + mit[20:40] + ["and", "truly"] + mit[41:]
    rows = [
        (1, " ".join(["x"] * 5 + changed + ["y"])),
        (2, " ".join(mit[: len(mit) // 2])),  # too little of it
        (3, " ".join([*mit, *bsd, *mit])),
        (4, "Licensed under CC BY-NC 4.0."),
        (5, "Licensed under the Apache License, Version 2.0. All rights reserved."),
        (6, " ".join(mit[40:] + ["z"] * 30 + mit[:40])),  # parts in the wrong order, neither enough
    ]
    found = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    spans = {d: [(s.label, s.start, s.end) for s in r.spans] for d, r in found.items()}
    assert spans[1] == [("mit", 5, 5 + len(changed))] and 0.95 < found[1].spans[0].share < 1
    assert spans[2] == []
    a, b = len(mit), len(mit) + len(bsd)
    assert spans[3] == [("mit", 0, a), ("bsd", a, b), ("mit", b, a + b)]
    assert spans[4] == [("cc-by-nc-4.0", 0, 7)]
    rows = {r.doc_id: r for r in licenses.labelled(licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert (rows[5].base_labels, rows[5].labels, rows[5].score) == ("reserved", "apache-2.0,reserved", 1.0)
    assert (rows[5].n_base, rows[5].first_word, rows[5].last_word) == (1, 8, 8)
    assert rows[4].base_labels == "cc-by" and rows[2].labels == "" and rows[2].score == 0 and rows[2].first_word is None
    assert len(spans[6]) <= 1


def test_licences_odd_rows(odd):
    found = licenses.labelled(licenses.scan(odd)).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.labels) for r in found) == [
        *((0, 7, ""), (1, 11, "reserved"), (1, 11, "reserved"), (2, 0, ""), (3, 0, ""), (4, 60_001, ""), (5, 0, ""))
    ]
    assert licenses.scan(odd.limit(0)).count() == 0
    with pytest.raises(ValueError):
        licenses.Scanner([("one", "word")], [])


# Prefix trie


def plain_trie(conversations):
    """All nodes of (conv_id -> turns) by listing every prefix."""
    members, children, ends = defaultdict(list), defaultdict(set), defaultdict(list)
    for conv_id, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(conv_id)
            if d:
                children[tuple(turns[: d - 1])].add(tuple(turns[:d]))
        ends[tuple(turns)].append(conv_id)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children.get(node, ())
        leaves[node] = sum(leaves[k] for k in below) or 1
        saved[node] = sum(saved[k] for k in below) + ((len(members[node]) - 1) * len(SPACE.findall(node[-1][1])) if node else 0)
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted(
        (
            *(len(n), min(m), min(members[n[:-1]]) if n else -1, len(m), len(children.get(n, ()))),
            *(leaves[n], saved[n], sha(ends.get(n, []))),
        )
        for n, m in members.items()
    )


def nodes_of(found):
    return sorted(
        (r.depth, r.conv_id, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256)
        for r in found.collect()
    )


def test_two_fattest(spark):
    pairs = [(a, b) for b in range(1, 70) for a in range(b)] + [(2**20 - 1, 2**20), (2**20, 2**20 + 5)]
    frame = spark.createDataFrame(pairs, "a int, b int")
    for r in frame.select("a", "b", trie.two_fattest(F.col("a"), F.col("b")).alias("f")).collect():
        assert r.a < r.f <= r.b and (r.f & -r.f) == max(k & -k for k in range(r.a + 1, min(r.b, r.a + 80) + 1))


def test_trie_equals_brute_force(spark):
    rng = random.Random(1)
    said = [("user", "one two"), ("assistant", "one"), ("user", ""), ("assistant", "one two"), ("", "\t a  b c ")]
    conversations = {}
    for k in range(150):
        base = rng.choice(list(conversations.values()) or [[]])
        turns = base[: rng.randint(0, len(base))] + [rng.choice(said) for _ in range(rng.choice([0, 1, 2, 9]))]
        conversations[k * 7] = turns[:40] or [said[0]]
    conversations[5000] = [said[k % 2] for k in range(300)]  # long ones, one a prefix of the other
    conversations[5001] = conversations[5000][:133]
    rows = [(c, t, *turn, "x") for c, turns in conversations.items() for t, turn in enumerate(turns)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns string").repartition(3)
    assert nodes_of(trie.prefix_trie(trie.gathered(frame))) == plain_trie(conversations)


def test_query_of_the_trie_equals_brute_force(spark):
    own = defaultdict(list)
    for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").orderBy("conv_id", "turn").collect():
        own[r.conv_id].append((r.role or "", r.text or ""))
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    assert nodes_of(trie.query(spark, FOLDER)) == plain_trie(built)


def test_fat_binary_search_goes_on_where_it_was(spark):
    """Later batches meet a trie of many nodes: with batches of other sizes the nodes are the same."""
    rows = [(c, t, "user", str((c * 37) % (2 + 3 * t))) for c in range(300) for t in range(c % 9)]
    turns = trie.gathered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    conversations = defaultdict(list)
    for c, _, role, text in rows:
        conversations[c].append((role, text))
    assert nodes_of(trie.prefix_trie(turns, (1, 3, 9))) == plain_trie(conversations)


def test_trie_odd_rows(spark):
    rows = [(1, None, None, None), (1, 1, "user", "x y"), (1, 1, "user", "x y"), (2, None, "", ""), (None, 1, "user", "nobody's")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    none, x = ("", ""), ("user", "x y")
    assert nodes_of(trie.prefix_trie(trie.gathered(frame))) == plain_trie({1: [none, x, x], 2: [none]})
    empty = trie.gathered(frame.limit(0))
    assert trie.prefix_trie(empty).count() == trie.grafted(empty).count() == 0
    turnless = trie.gathered(frame).select("conv_id", F.slice("turns", 1, 0).alias("turns"))
    assert nodes_of(trie.prefix_trie(turnless)) == plain_trie({1: [], 2: []})
