"""Periodic runs of words: seeds on diagonals, extended as far as both copies agree.

A run of period q holds its words again q places on, over a guaranteed overlap: three periods or more. Periods are taken
in levels; a level's k-grams are as long as the overlap its smallest period guarantees and not shorter than its largest
period, so inside a run the next occurrence of a k-gram is exactly one smallest period away. Each k-gram is paired with
its next occurrence alone, never with all of them. Pairs of one distance lie on one diagonal; a table of the furthest
place covered per distance keeps a pair inside a stretch that is already known from being extended again.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from access_engine.llm.text import WORD, crc32_sql, mix, powers, text_blocks

#: A run has at least this many words, and at least this many periods.
LEAST = 6
TIMES = 4

_FOUND = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def overlap(period: int) -> int:
    """Fewest words that a run of this period shares with itself one period on."""
    return max(LEAST, TIMES * period) - period


def levels(longest: int) -> Iterator[tuple[int, int]]:
    """(low, k): periods above ``low`` and up to ``k`` are found by k-grams; for texts of ``longest`` words."""
    low = 0
    while max(LEAST, TIMES * (low + 1)) <= longest:
        k = overlap(low + 1)
        yield low, k
        low = k


def _agreeing(ids: np.ndarray, at: int, lag: int, stop: int, step: int) -> int:
    """First place from ``at`` in direction ``step``, before ``stop``, whose word differs from the one ``lag`` on."""
    size = 16
    while (stop - at) * step > 0:
        there = np.arange(at, max(at - size, stop) if step < 0 else min(at + size, stop), step)
        wrong = np.flatnonzero(ids[there] != ids[there + lag])
        if len(wrong):
            return int(there[wrong[0]])
        at, size = int(there[-1]) + step, size * 2
    return stop


def find_runs(ids: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run in the texts ``ids[bounds[t] : bounds[t + 1]]``, sorted.

    ``ids`` are 64-bit numbers, equal for equal words. Starts count from the first word of the first text.
    """
    sizes = np.diff(bounds)
    text = np.repeat(np.arange(len(sizes)), sizes)
    ends = bounds[1:][text]
    up, down = powers(len(ids) + 1)
    sums = np.zeros(len(ids) + 1, np.uint64)
    np.cumsum(mix(ids) * up[: len(ids)], out=sums[1:])
    salt = mix(text.astype(np.uint64) + np.uint64(1))
    open_, runs = np.arange(len(ids)), []
    for low, k in levels(int(sizes.max(initial=0))):
        open_ = open_[open_ + k <= ends[open_]]
        if not len(open_):
            break
        grams = mix((sums[open_ + k] - sums[open_]) * down[open_] + salt[open_])
        order = np.argsort(grams, kind="stable")
        grams, places = grams[order], open_[order]
        again = np.flatnonzero(grams[1:] == grams[:-1])
        first, lag = places[again], places[again + 1] - places[again]
        repeated = np.zeros(len(ids), bool)
        repeated[first] = repeated[places[again + 1]] = True
        open_ = np.flatnonzero(repeated)  # longer grams repeat only where shorter ones do
        seeds = np.flatnonzero((lag > low) & (lag <= k))
        first, lag = first[seeds], lag[seeds]
        order = np.lexsort((first, lag))
        first, lag = first[order], lag[order]
        # Neighbouring seeds of one diagonal are one stretch: only its first seed is extended.
        head = np.ones(len(first), bool)
        head[1:] = (lag[1:] != lag[:-1]) | (first[1:] != first[:-1] + 1)
        covered: dict[int, int] = {}
        for at, q in zip(first[head].tolist(), lag[head].tolist(), strict=True):
            if at < covered.get(q, 0):
                continue
            begin = _agreeing(ids, at - 1, q, int(bounds[text[at]]) - 1, -1) + 1
            end = _agreeing(ids, at + k, q, int(ends[at]) - q, 1)
            covered[q] = end
            length = end - begin + q
            if length >= max(LEAST, TIMES * q):
                runs.append((begin, length, q))
    runs.sort(key=lambda run: (run[0], run[2]))
    return runs


def runs_of(words: list[bytes], bounds: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs of several texts' words. Words are compared by hash first; a run whose words differ has them numbered instead."""
    found = find_runs(np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64), bounds)
    if any(words[s : s + n - q] != words[s + q : s + n] for s, n, q in found):
        numbers: dict[bytes, int] = {}
        ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
        found = find_runs(ids.view(np.uint64), bounds)
    return found


def _marked(ids: pa.Array, texts: list[list[bytes]]) -> pa.RecordBatch:
    bounds = np.cumsum([0, *map(len, texts)])
    runs: list[list[dict[str, int]]] = [[] for _ in texts]
    dropped: dict[int, np.ndarray] = {}
    found = runs_of(list(chain.from_iterable(texts)), bounds)
    owner = np.searchsorted(bounds, [s for s, _, _ in found], "right") - 1
    for (start, length, period), t in zip(found, owner.tolist(), strict=True):
        start -= int(bounds[t])
        runs[t].append({"start": start, "length": length, "period": period})
        dropped.setdefault(t, np.zeros(len(texts[t]), bool))[start + period : start + length] = True
    kept = [
        b" ".join(words if t not in dropped else [w for w, out in zip(words, dropped[t].tolist(), strict=True) if not out])
        for t, words in enumerate(texts)
    ]
    kind = pa.list_(pa.struct([(name, pa.int64()) for name in ("start", "length", "period")]))
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(np.diff(bounds)), pa.array(runs, kind), pa.array(kept, pa.binary()).view(pa.string())],
        ["doc_id", "n_words", "runs", "collapsed"],
    )


def periodic_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row of ``docs``.

    ``runs`` holds the (start, length, period) of each run by start and period, in words from 0: a stretch that repeats
    with this smallest period, at least ``LEAST`` words and ``TIMES`` periods long, and that neither neighbouring word
    prolongs. ``collapsed`` is the text's words parted by single spaces, without those that a run covers after its first
    period. Null, empty and blank texts have no words and an empty ``collapsed``; repeated rows are each searched, and a
    row without doc_id like any other. Texts are worked on whole, about a megabyte of them at once; a longer text by
    itself, in memory that grows with its length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in text_blocks(batch.column("text")):
                held, cuts = data.tobytes(), offsets.tolist()
                texts = [held[a:b].split() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield _marked(batch.column("doc_id").slice(low, high - low), texts)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _FOUND)


def planted(docs: DataFrame) -> DataFrame:
    """``docs`` with a repeated passage in a tenth of its texts, chosen by crc32 of doc_id.

    With h the checksum and g = floor(h / 10): where h ends in 0, each word i from a = g % n on becomes the text's word
    a + (i - a) % p, p = 1 + floor((n - a) / (3 + g % 8)). Texts without words and rows without doc_id stay.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    rows = docs.select("doc_id", "text", g.alias("g"), F.when(h % 10 == 0, words).alias("words"))
    rows = rows.withColumn("n", F.size("words").cast("long"))
    a, n = F.expr("g % n"), F.col("n")
    p = F.expr("1 + (n - g % n) div (3 + g % 8)")
    rows = rows.select("doc_id", "text", "words", "n", a.alias("a"), p.alias("p"))

    def source(i: Column) -> Column:
        return F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")

    changed = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get("words", source(i))), " ")
    return rows.select("doc_id", F.when(n > 0, changed).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """Counts and checksums of the runs: the columns of the registered query."""
    longest = F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"], r["period"])))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = F.get(longest, F.lit(0))
    length = -best["l"]
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        length.alias("length"),
        best["period"].alias("period"),
        F.floor(F.lit(1000) * length / best["period"]).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


# Stretches of words that equal the word q places on, for every q; those that lie in one of a smaller period are none.
SQL = f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS words, len(words) AS n,
    {crc32_sql("doc_id::varchar")} AS h, h // 10 AS g
  FROM documents
), places AS (
  SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n ELSE n END AS a, 1 + (n - a) // (3 + g % 8) AS p FROM docs
), word AS (
  SELECT r, n, i, words[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END] AS w FROM (SELECT *, unnest(range(n)) AS i FROM places)
), pairs AS (
  SELECT x.r, x.i, y.i - x.i AS q FROM word x JOIN word y ON x.r = y.r AND x.w = y.w AND y.i > x.i AND y.i - x.i <= x.n // {TIMES}
), stretches AS (
  SELECT r, q, min(i) AS s, count(*) + q AS l
  FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM pairs) GROUP BY r, q, island
), long AS (
  SELECT * FROM stretches WHERE l >= greatest({LEAST}, {TIMES} * q)
), runs AS (
  SELECT * FROM long a WHERE NOT EXISTS (SELECT 1 FROM long b WHERE b.r = a.r AND b.q < a.q AND b.s <= a.s AND b.s + b.l >= a.s + a.l)
), listed AS (
  SELECT r, count(*) AS n_runs, list({{'s': s, 'l': l, 'q': q}} ORDER BY l DESC, s, q)[1] AS best,
    string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS lines
  FROM runs GROUP BY r
), dropped AS (
  SELECT DISTINCT r, unnest(range(s + q, s + l)) AS i FROM runs
), kept AS (
  SELECT r, string_agg(w, ' ' ORDER BY i) AS text FROM word ANTI JOIN dropped USING (r, i) GROUP BY r
)
SELECT doc_id, coalesce(n_runs, 0)::bigint AS n_runs, best.s::bigint AS start, best.l::bigint AS length, best.q::bigint AS period,
  (1000 * best.l // best.q)::bigint AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256,
  sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM docs LEFT JOIN listed USING (r) LEFT JOIN kept USING (r)
"""


def query(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return digests(periodic_runs(planted(docs)))
