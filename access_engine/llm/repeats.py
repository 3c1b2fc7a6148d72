"""Repeated passages: byte strings of at least ``LENGTH`` that also start elsewhere, found on suffix order.

A text's windows of ``LENGTH`` bytes are parted by the smallest hash of the 128-byte strings inside them, so equal
windows, in whatever texts, get the same key. Runs of windows with a key that occurs twice go to the key's group. A
group's windows are put in suffix order; the previous and the next smaller position in that order give, for every
window, the longest match with an earlier one (the longest previous factor), and the greater positions that with a
later one. A group that is too large is parted beforehand, see `_resolved`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from access_engine.llm.text import byte_view, mix, powers, text_blocks
from access_engine.storage import stored

LENGTH = 400
GRAM = 128
#: Bytes of units that are sorted together, a few groups of them; a single group may have more, up to the next limit.
SORT_BYTES = 1 << 19
#: Bytes of a group that are sorted together at most; larger groups are parted.
GROUP_BYTES = 4 << 20
#: Windows of a piece that a large group is parted into.
PIECE = 64

_PLACE = np.uint64(24)
_MASK = np.uint64((1 << 24) - 1)
_SLICE = 1 << 22


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of all ``size``-byte strings of ``data``."""
    if len(data) < size:
        return np.zeros(0, np.uint64)
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mix((sums[size:] - sums[:-size]) * down[: len(data) - size + 1])


def window_anchors(data: np.ndarray) -> np.ndarray:
    """For every window of ``LENGTH`` bytes the hash (40 bits) and place (24 bits) of its first smallest string."""
    hashes = gram_hashes(data, GRAM)
    least = (hashes & ~_MASK) | np.arange(len(hashes), dtype=np.uint64)
    width, size = LENGTH - GRAM + 1, 1
    if len(least) < width:
        return least[:0]
    while size * 2 <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    return np.minimum(least[: len(least) - (width - size)], least[width - size :])


def segments(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows of one key: (text, first window, end, key, place of the first and of the last smallest string)."""
    anchors = window_anchors(data)
    inside = np.zeros(len(anchors) + 1, np.int32)
    long = np.flatnonzero(np.diff(offsets) >= LENGTH)
    np.add.at(inside, offsets[long], 1)
    np.add.at(inside, offsets[long + 1] - LENGTH + 1, -1)
    at = np.flatnonzero(np.cumsum(inside[:-1]))
    if not len(at):
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    found = anchors[at]
    key = (found >> _PLACE).astype(np.int64)
    gap = np.diff(at) > 1
    new = np.concatenate([[True], gap | (key[1:] != key[:-1])])
    place = (found & _MASK).astype(np.int64)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    text = np.searchsorted(offsets, at[first], "right") - 1
    base = offsets[text]
    return text, at[first] - base, at[last] + 1 - base, key[first], place[first] - base, place[last] - base


def _segment_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["digest", "key", "lo", "hi", "first", "last"]
    for batch in batches:
        digest = batch.column("digest")
        for low, _, data, offsets in text_blocks(batch.column("text")):
            for start in range(0, len(data), _SLICE):  # more than one slice only for a very long single text
                end = min(len(data), start + _SLICE + LENGTH - 1)
                part = offsets if len(data) <= _SLICE else np.array([0, end - start])
                text, lo, hi, key, first, last = segments(data[start:end], part)
                places = (pa.array(c + start) for c in (lo, hi, first, last))
                yield pa.RecordBatch.from_arrays([digest.take(pa.array(text + low)), pa.array(key), *places], names)


def _ranks(key: np.ndarray) -> np.ndarray:
    """Dense ranks of integers."""
    order = np.argsort(key)
    ordered = key[order]
    rank = np.zeros(len(key), np.uint64)
    rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])]) if len(key) else 0
    return rank


def nearest_smaller(values: np.ndarray) -> np.ndarray:
    """For every place the last one before it with a smaller value, or -1. Values are distinct."""
    near = np.arange(-1, len(values) - 1)
    todo = np.arange(1, len(values))
    for _ in range(4):  # nearly all are found by following a few links
        todo = todo[(near[todo] >= 0) & (values[near[todo]] > values[todo])]
        near[todo] = near[near[todo]]
    todo = todo[(near[todo] >= 0) & (values[near[todo]] > values[todo])]
    if not len(todo):
        return near
    least = [values]  # minima of the 1, 2, 4, ... places up to each
    while 1 << len(least) <= len(values):
        size = 1 << (len(least) - 1)
        least.append(np.append(least[-1][:size], np.minimum(least[-1][size:], least[-1][:-size])))
    at = near[todo]
    for k in reversed(range(len(least))):
        skip = at >= 0
        skip[skip] = least[k][at[skip]] > values[todo[skip]]
        at[skip] -= 1 << k
    near[todo] = np.maximum(at, -1)
    return near


class SuffixOrder:
    """Order of the windows of ``LENGTH`` bytes that start at ``starts`` (ascending) in ``data``."""

    def __init__(self, data: np.ndarray, starts: np.ndarray):
        self.starts = starts
        padded = np.concatenate([data, np.zeros(LENGTH, np.uint8)]).astype(np.uint64)
        self.equal = {1: padded}
        size, now = 1, padded
        while size < 8:  # the bytes themselves
            now = (now << np.uint64(8 * size)) | np.append(now[size:], np.zeros(size, np.uint64))
            size *= 2
            self.equal[size] = now
        now = _ranks(now)
        self.equal[8] = now
        while size < 256:  # ranks of pairs of ranks
            now = _ranks((now << np.uint64(32)) | np.append(now[size:], np.zeros(size, np.uint64)))
            size *= 2
            self.equal[size] = now
        most = _ranks((self.equal[256][starts] << np.uint64(32)) | self.equal[128][starts + 256])
        whole = (most << np.uint64(32)) | self.equal[16][starts + 384]
        self.order = np.argsort(whole, kind="stable")  # window numbers in suffix order, equal ones by position

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of windows a and b, ``LENGTH`` at most; -1 as a window has none."""
        there = (a >= 0) & (b >= 0)
        x, y = self.starts[a], self.starts[b]
        length = np.zeros(len(a), np.int64)
        for size in (256, 128, 64, 32, 16, 8, 4, 2, 1):
            fits = length + size <= LENGTH
            step = np.where(fits, length, 0)
            same = fits & (self.equal[size][x + step] == self.equal[size][y + step])
            length += size * same
        return np.where(there, length, 0)

    def longest(self, later: bool = False) -> np.ndarray:
        """Longest previous factor of every window, or with ``later`` the longest match with a later one."""
        place = -self.order if later else self.order
        out = np.zeros(len(place), np.int64)
        for turn in (False, True):
            place_now = place[::-1] if turn else place
            near = nearest_smaller(place_now)
            order_now = self.order[::-1] if turn else self.order
            other = np.where(near >= 0, order_now[near], -1)
            out[order_now] = np.maximum(out[order_now], self.common(order_now, other))
        return out


def repeated_runs(units: list[tuple], keep_first: bool) -> Iterator[tuple]:
    """(digest, start, end): bytes that repeated windows of the units cover.

    A unit is (doc_id, digest, first window, windows, bytes). A window counts if an earlier one, or without
    ``keep_first`` any other, is equal; earlier is by doc_id (null last), digest and place.
    """
    units = sorted({u[:3]: u for u in units}.values(), key=lambda u: (u[0] is None, u[0] or 0, u[1], u[2]))
    if not units:
        return
    sizes = np.array([len(u[4]) for u in units])
    counts = np.array([u[3] for u in units])
    data = np.frombuffer(b"".join(u[4] for u in units), np.uint8)
    base = np.cumsum(sizes) - sizes
    first = np.cumsum(counts) - counts
    starts = np.arange(counts.sum()) + np.repeat(base - first, counts)
    order = SuffixOrder(data, starts)
    hit = order.longest() >= LENGTH
    if not keep_first:
        hit |= order.longest(later=True) >= LENGTH
    edge = np.zeros(len(hit) + 1, bool)
    edge[first] = True
    edge[-1] = True
    begins = np.flatnonzero(hit & (edge[:-1] | ~np.append(False, hit[:-1])))
    ends = np.flatnonzero(hit & (edge[1:] | ~np.append(hit[1:], False))) + 1
    owner = np.searchsorted(first, begins, "right") - 1
    for k, a, b in zip(owner.tolist(), (begins - first[owner]).tolist(), (ends - first[owner]).tolist(), strict=True):
        yield units[k][1], units[k][2] + a, units[k][2] + b - 1 + LENGTH


_SPANS = "array<struct<start: bigint, end: bigint>>"
_UNIT = "doc_id long, digest binary, lo long, n long, key long, large boolean, bytes binary"
_FOUND = "digest binary, start long, end long"


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The candidate runs of windows of each text with their bytes."""
    names = ["doc_id", "digest", "lo", "n", "key", "large", "bytes"]
    for batch in batches:
        data, offsets = byte_view(batch.column("text"))
        rows, size = [], 0
        for k in range(batch.num_rows):
            doc_id, digest = batch.column("doc_id")[k].as_py(), batch.column("digest")[k].as_py()
            text = data[offsets[k] : offsets[k + 1]]
            for s in batch.column("runs")[k].as_py():
                lo, hi = s["lo"], s["hi"]
                rows.append((doc_id, digest, lo, hi - lo, s["key"], s["large"], text[lo : hi - 1 + LENGTH].tobytes()))
                size += hi - lo + LENGTH
                if size > 8 << 20:
                    yield _batch(rows, names)
                    rows, size = [], 0
        yield _batch(rows, names)


_TYPES = {"large": pa.bool_(), "doc_id": pa.int64(), "digest": pa.binary(), "bytes": pa.binary(), "content": pa.binary()}


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, _TYPES.get(n, pa.int64())) for n, c in zip(names, columns, strict=True)], names
    )


def _searched(keep_first: bool):
    """What repeats inside groups, over units sorted by key; several groups are sorted together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        key, size = None, 0
        for batch in batches:
            columns = (batch.column(n).to_pylist() for n in ("key", "doc_id", "digest", "lo", "n", "bytes"))
            for k, *unit in zip(*columns, strict=True):
                if k != key and size > SORT_BYTES:
                    yield _batch(list(repeated_runs(held, keep_first)), ["digest", "start", "end"])
                    held, size = [], 0
                held.append(tuple(unit))
                key, size = k, size + len(unit[4])
        yield _batch(list(repeated_runs(held, keep_first)), ["digest", "start", "end"])

    return run


def _grouped(units: DataFrame, keep_first: bool) -> DataFrame:
    ordered = units.select("doc_id", "digest", "lo", "n", "key", "bytes").repartition("key").sortWithinPartitions("key")
    return ordered.mapInArrow(_searched(keep_first), _FOUND)


def _pieces(width: int):
    """Units cut into pieces of ``width`` windows at most, keyed by the bytes that all windows of a piece share.

    Cuts stand at multiples of ``width`` from the window's smallest string, so equal windows get equal keys.
    """
    names = ["doc_id", "digest", "lo", "n", "key", "content", "bytes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            columns = (batch.column(n).to_pylist() for n in ("doc_id", "digest", "lo", "n", "bytes"))
            rows = []
            for doc_id, digest, lo, n, text in zip(*columns, strict=True):
                anchors = (window_anchors(np.frombuffer(text, np.uint8)) & _MASK).astype(np.int64)[:n]
                block = (anchors - np.arange(n)) // width
                cut = np.append(np.flatnonzero(np.append(True, (np.diff(anchors) != 0) | (np.diff(block) != 0))), n)
                for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                    top = int(anchors[a] - block[a] * width)  # start of the last window the block can have
                    shared = text[top : top - width + 1 + LENGTH]
                    own = text[a : b - 1 + LENGTH]
                    rows.append((doc_id, digest, lo + a, b - a, xxhash.xxh3_64_intdigest(shared) - (1 << 63),
                                 xxhash.xxh3_128_digest(own), own if width > 1 else b""))
                if len(rows) > 10_000:
                    yield _batch(rows, names)
                    rows = []
            yield _batch(rows, names)

    return run


_PIECE = "doc_id long, digest binary, lo long, n long, key long, content binary, bytes binary"


def _resolved(units: DataFrame, keep_first: bool) -> DataFrame:
    """(digest, start, end) of what repeats among the units.

    Units of groups up to ``GROUP_BYTES`` meet by key and are searched whole. Larger groups never meet: their units
    are cut into pieces of ``PIECE`` windows; pieces that share their core with no other have no repeat, equal pieces
    are all repeats of the first, and of each set of equal pieces one stands for all in the pieces' own groups. Where
    such a group is too large again, its windows are compared by a 128-bit hash of their bytes, counted with map-side
    combination.
    """
    units = stored(units, "units")
    first = _grouped(units.where("NOT large"), keep_first)

    def cut(rows: DataFrame, width: int) -> DataFrame:
        return stored(rows.select("doc_id", "digest", "lo", "n", "bytes").mapInArrow(_pieces(width), _PIECE), "pieces")

    def equal(pieces: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Repeats among equal pieces, and (key, content, one) with the first of each set."""
        place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest", "lo")
        sets = pieces.groupBy("key", "content").agg(F.min(place).alias("one"), F.max(place).alias("other"))
        more = sets.where("one != other").select("content", "one")
        members = pieces.withColumn("place", place).join(more, "content")
        if keep_first:
            members = members.where("place != one")
        return members.select("digest", F.col("lo").alias("start"), (F.col("lo") + F.col("n") - 1 + LENGTH).alias("end")), sets

    pieces = cut(units.where("large"), PIECE)
    same, sets = equal(pieces)
    shared = sets.groupBy("key").count().where("count > 1")
    shared = shared.select("key", (F.col("count") * (PIECE + LENGTH) > GROUP_BYTES).alias("large"))
    ones = sets.select("key", "one.digest", "one.lo").join(shared, "key")
    ones = ones.select(F.col("key").alias("k"), F.col("digest").alias("d"), F.col("lo").alias("l"), "large")
    apart = pieces.join(ones, (F.col("key") == F.col("k")) & (F.col("digest") == F.col("d")) & (F.col("lo") == F.col("l")))
    second = _grouped(apart.where("NOT large"), keep_first)
    alike, _ = equal(cut(apart.where("large"), 1))
    return first.union(same).union(second).union(alike)


def _covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The spans of each text as maximal runs, and the bytes outside them."""
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        data, offsets = byte_view(batch.column("text"))
        all_spans, kept = [], []
        for k, found in enumerate(batch.column("found").to_pylist()):
            text = data[offsets[k] : offsets[k + 1]]
            spans, parts, done = [], [], 0
            for a, b in sorted((s["start"], s["end"]) for s in found):
                if spans and a <= spans[-1]["end"]:
                    spans[-1]["end"] = max(spans[-1]["end"], b)
                else:
                    spans.append({"start": a, "end": b})
            for s in spans:
                parts.append(text[done : s["start"]].tobytes())
                done = s["end"]
            all_spans.append(spans)
            kept.append(b"".join([*parts, text[done:].tobytes()]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("digest"), pa.array(all_spans, spans_type), pa.array(kept, pa.binary())], ["digest", "spans", "kept"]
        )


def removed_spans(docs: DataFrame, keep_first: bool = True) -> tuple[DataFrame, DataFrame]:
    """What repeats in the texts of ``docs``.

    The first table is (doc_id, digest, n_bytes, sha256, first, copies), a row per row of ``docs``: the MD5 digest
    of its text, the text's SHA-256, the smallest doc_id of the rows with this text and their number. The second is
    (digest, spans, kept) of texts of which something else holds a part: maximal removed runs of bytes, and what
    remains. Texts are UTF-8, null is empty. With ``keep_first`` an occurrence stays if none is earlier by doc_id
    (null last), else all go; copies of whole texts are left to the caller, who has ``first`` and ``copies``.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    given = docs.select(F.col("doc_id").cast("long"), text.alias("text")).withColumn("digest", F.unhex(F.md5("text")))
    marks = stored(
        given.select(
            "doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes"), F.unhex(F.sha2("text", 256)).alias("sha256")
        ),
        "marks",
    )
    classes = marks.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    long = given.where(F.octet_length("text") >= LENGTH)
    runs = stored(
        long.select("digest", "text").mapInArrow(_segment_rows, "digest binary, key long, lo long, hi long, first long, last long"), "runs"
    )
    same = F.xxhash64("digest")
    repeated = (
        runs.groupBy("key")
        .agg(F.min(same).alias("a"), F.max(same).alias("b"), F.min("first").alias("first"), F.max("last").alias("last"),
             F.sum(F.col("hi") - F.col("lo") + LENGTH).alias("bytes"))
        .where("a != b OR first != last")
        .select("key", (F.col("bytes") > GROUP_BYTES).alias("large"))
    )
    wanted = runs.join(repeated, "key").groupBy("digest").agg(F.collect_set(F.struct("lo", "hi", "key", "large")).alias("runs"))
    wanted = wanted.join(classes, "digest").select(F.col("digest").alias("d"), F.col("first").alias("f"), "runs")
    texts = stored(
        long.join(wanted, (F.col("digest") == F.col("d")) & F.col("doc_id").eqNullSafe(F.col("f"))).select(
            "doc_id", "digest", "text", "runs"
        ),
        "texts",
    )
    found = _resolved(texts.mapInArrow(_units, _UNIT), keep_first)
    spans = found.groupBy("digest").agg(F.collect_set(F.struct("start", "end")).alias("found"))
    spans = spans.select(F.col("digest").alias("d"), "found")
    # Rows that repeat in doc_id and text have given their text twice.
    touched = texts.select("digest", "text").join(spans, F.col("digest") == F.col("d")).select("digest", "text", "found")
    out = touched.dropDuplicates(["digest"]).mapInArrow(
        _covered, f"digest binary, spans {_SPANS}, kept binary"
    )
    return marks.join(classes, "digest"), out


def without_repeats(docs: DataFrame, keep_first: bool = True) -> DataFrame:
    """(doc_id, n_bytes, spans, kept, sha256) of every row: removed byte runs, and the rest with its SHA-256.

    ``kept`` is null where nothing is removed, the text is then as it was. Of equal texts of ``LENGTH`` bytes or
    more, with ``keep_first`` all but those of the smallest doc_id go (rows that repeat that doc_id stay with it),
    else all; shorter texts always stay. Null texts are empty; a row without doc_id is later than any with one.
    """
    rows, parts = removed_spans(docs, keep_first)
    copy = (F.col("copies") > 1) & (F.col("n_bytes") >= LENGTH)
    if keep_first:
        copy &= ~F.col("doc_id").eqNullSafe(F.col("first"))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    joined = rows.join(parts.withColumnRenamed("digest", "d"), F.col("digest") == F.col("d"), "left")
    return joined.select(
        "doc_id",
        "n_bytes",
        F.when(copy, whole).otherwise(F.coalesce("spans", F.array().cast(_SPANS))).alias("spans"),
        F.when(copy, F.lit(b"")).otherwise(F.col("kept")).alias("kept"),
        F.when(copy, F.sha2(F.lit(b""), 256)).otherwise(
            F.when(F.col("kept").isNull(), F.lower(F.hex("sha256"))).otherwise(F.sha2("kept", 256))
        ).alias("sha256"),
    )


# Hashes of 2, 4, 8, 16, 80 and 400 bytes from those of the strings they consist of, for every place.
SQL = """
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents
), bytes AS (
  SELECT r, unnest(regexp_extract_all(hex(b), '..')) AS h1, unnest(range(octet_length(b))) AS i FROM docs
), h2 AS (SELECT r, i, h1, md5(h1 || lead(h1, 1) OVER w) AS h2 FROM bytes WINDOW w AS (PARTITION BY r ORDER BY i)
), h4 AS (SELECT r, i, h1, md5(h2 || lead(h2, 2) OVER w) AS h4 FROM h2 WINDOW w AS (PARTITION BY r ORDER BY i)
), h8 AS (SELECT r, i, h1, md5(h4 || lead(h4, 4) OVER w) AS h8 FROM h4 WINDOW w AS (PARTITION BY r ORDER BY i)
), h16 AS (SELECT r, i, h1, md5(h8 || lead(h8, 8) OVER w) AS h16 FROM h8 WINDOW w AS (PARTITION BY r ORDER BY i)
), h80 AS (SELECT r, i, h1, md5(h16 || lead(h16, 16) OVER w || lead(h16, 32) OVER w || lead(h16, 48) OVER w || lead(h16, 64) OVER w) AS h80
  FROM h16 WINDOW w AS (PARTITION BY r ORDER BY i)
), h400 AS (SELECT r, i, h1, md5(h80 || lead(h80, 80) OVER w || lead(h80, 160) OVER w || lead(h80, 240) OVER w || lead(h80, 320) OVER w) AS h400
  FROM h80 WINDOW w AS (PARTITION BY r ORDER BY i)
), starts AS (
  SELECT r, i, h1, h400 IS NOT NULL AND count(*) OVER (PARTITION BY h400) > 1 AS again FROM h400
), covered AS (
  SELECT r, i, h1, max(again::int) OVER (PARTITION BY r ORDER BY i ROWS 399 PRECEDING) AS gone FROM starts
), edges AS (
  SELECT *, gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY r ORDER BY i), 0) = 0 AS opens FROM covered
), sums AS (
  SELECT r, sum(gone) AS n, count_if(opens) AS spans, sha256(unhex(coalesce(string_agg(h1, '' ORDER BY i) FILTER (gone = 0), ''))) AS kept
  FROM edges GROUP BY r
)
SELECT doc_id, octet_length(b)::bigint AS n_bytes, coalesce(n, 0)::bigint AS n_removed, coalesce(spans, 0)::bigint AS n_spans,
  coalesce(kept, sha256(''::blob)) AS kept_sha256, coalesce(n, 0) > 0 AS has_repeat
FROM docs LEFT JOIN sums USING (r)
"""


def query(spark: SparkSession, folder: str) -> DataFrame:
    found = without_repeats(spark.read.parquet(f"{folder}/documents.parquet"), keep_first=False)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.col("sha256").alias("kept_sha256"),
        (F.size("spans") > 0).alias("has_repeat"),
    )
