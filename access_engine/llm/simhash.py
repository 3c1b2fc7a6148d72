"""SimHash near duplicates: fingerprints, links found with pivot distance tables, groups.

A fingerprint's coordinates are its Hamming distances to reference fingerprints (pivots). Two fingerprints that differ
in few bits have coordinates that differ by no more than that, so most pairs are discarded on the tables and only
survivors are compared. Pairs are only looked at where fingerprints agree on two of five blocks of bits, which any two
within three bits do.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from access_engine.llm.components import components
from access_engine.llm.text import LOWER, byte_view, mix
from access_engine.storage import stored

SHINGLE = 3
SEED = 42
BITS = 3
#: Reference fingerprints: pseudo-random, the same everywhere.
PIVOTS = mix(np.arange(1, 25, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
#: A group of fingerprints that agree on two blocks and has more members is split by more blocks, see `links`.
SPLIT = 1024

_LOWER = LOWER.tobytes()


def _blocks(bits: list[int], parts: int) -> list[int]:
    """Masks of nearly equal blocks of the given bits."""
    return [sum(1 << b for b in part.tolist()) for part in np.array_split(np.array(bits), parts)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


_FIVE = _blocks(list(range(64)), 5)
COARSE = [_FIVE[i] | _FIVE[j] for i, j in combinations(range(5), 2)]
#: For each coarse mask, masks of five of eight blocks of the bits that it leaves open.
FINE = [
    [m | sum(eight[k] for k in some) for some in combinations(range(8), 5)]
    for m in COARSE
    for eight in [_blocks([b for b in range(64) if not m >> b & 1], 8)]
]


def fingerprint(text: bytes) -> int:
    """SimHash of the lower-cased word shingles of a UTF-8 text, repeats included; 0 without words."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(SHINGLE)), strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, SEED) for s in shingles), np.uint64)
    ones = np.zeros(64, np.int64)
    for low in range(0, len(hashes), 1 << 14):
        part = np.unpackbits(hashes[low : low + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += part.sum(0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(hashes), bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row; ``fp`` is the fingerprint as a signed long."""
    return _marked(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")))


def _marked(rows: DataFrame) -> DataFrame:
    """Rows of a name and a text with the text's fingerprint in its place."""
    name, kind = rows.columns[0], rows.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = byte_view(batch.column("text"))
            found = [fingerprint(data[a:b].tobytes()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            fp = pa.array(np.array(found, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(name), fp], [name, "fp"])

    return rows.mapInArrow(run, f"{name} {kind}, fp long")


def survivors(fp: np.ndarray, a: np.ndarray, b: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which pairs (a, b) differ in at most ``BITS`` bits: pivot coordinates first, then the fingerprints."""
    left = np.arange(len(a))
    for row in table:
        left = left[np.abs(row[a[left]] - row[b[left]]) <= BITS]
        if not len(left):
            return left
    return left[np.bitwise_count(fp[a[left]] ^ fp[b[left]]) <= BITS]


def pivot_table(fp: np.ndarray) -> np.ndarray:
    """Hamming distances, one row per pivot."""
    return np.stack([np.bitwise_count(fp ^ p).astype(np.int8) for p in PIVOTS]) if len(fp) else np.zeros((0, 0), np.int8)


def _forest(fp: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fewest links that connect all linked members of each group; groups are ``fp[bounds[k] : bounds[k + 1]]``.

    Members are compared with those ``offset`` places on, all groups at once; pairs that links found so far already
    connect are not compared.
    """
    sizes = np.diff(bounds)
    last = np.repeat(bounds[1:], sizes)
    table, label = pivot_table(fp), np.arange(len(fp))
    out_a, out_b = [], []

    def root(k: int) -> int:
        while label[k] != k:
            label[k] = label[label[k]]
            k = label[k]
        return k

    alive = np.arange(len(fp))
    for offset in range(1, int(sizes.max(initial=0))):
        alive = alive[alive + offset < last[alive]]
        open_ = alive[label[alive] != label[alive + offset]]
        found = len(out_a)
        for low in range(0, len(open_), 1 << 18):
            part = open_[low : low + (1 << 18)]
            for k in part[survivors(fp, part, part + offset, table)].tolist():
                x, y = root(k), root(k + offset)
                if x != y:
                    label[max(x, y)] = min(x, y)
                    out_a.append(k)
                    out_b.append(k + offset)
        if len(out_a) > found:
            while (label[label] != label).any():
                label = label[label]
    return fp[out_a], fp[out_b]


def _grouped(limit: int | None):
    """A function for ``mapInPandas`` over (key, fp, way) sorted by way and key: links, and members of too large groups."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros((0, 3), np.int64)
        large = None  # the group whose members now pass on to be split
        for rows in _with_end(frames):
            block = rows[["way", "key", "fp"]].to_numpy(np.int64) if rows is not None else np.zeros((0, 3), np.int64)
            block = np.concatenate([held, block])
            if not len(block):
                continue
            new = np.concatenate([[True], (block[1:, :2] != block[:-1, :2]).any(1)])
            starts = np.flatnonzero(new)
            cut = len(block) if rows is None else starts[-1]
            if limit and rows is not None and len(block) - cut > limit:
                cut = len(block)  # it is too large already: pass its members on
            bounds = np.append(starts[starts < cut], cut)
            held = block[cut:]
            if len(bounds) < 2:
                continue
            sizes = np.diff(bounds)
            too_large = sizes > limit if limit else np.zeros(len(sizes), bool)
            if large is not None and (block[0, :2] == large).all():
                too_large[0] = True
            large = block[cut - 1, :2].copy() if too_large[-1] and cut == len(block) else None
            which = np.repeat(too_large, sizes)
            if which.any():
                split = block[:cut][which]
                yield pd.DataFrame({"a": split[:, 2], "b": split[:, 2], "way": split[:, 0]})
            fine = block[:cut][~which]
            if len(fine):
                a, b = _forest(fine[:, 2].copy().view(np.uint64), np.append(0, np.cumsum(sizes[~too_large])))
                yield pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64), "way": np.full(len(a), -1)})

    return run


def _with_end(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame | None]:
    yield from frames
    yield None


def _keyed(fps: DataFrame, masks: Column) -> DataFrame:
    """One row per fingerprint and mask: (way, key, fp)."""
    return fps.select("fp", F.posexplode(masks).alias("way", "mask")).select(
        F.col("way").cast("long"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp"
    )


def _array(masks: list[int]) -> Column:
    return F.array(*(F.lit(_signed(m)).cast("long") for m in masks))


def _together(keyed: DataFrame, limit: int | None) -> DataFrame:
    return (
        keyed.repartition("way", "key")
        .sortWithinPartitions("way", "key", "fp")
        .mapInPandas(_grouped(limit), "a long, b long, way long")
    )


def links(fps: DataFrame, split: int = SPLIT) -> DataFrame:
    """(a, b): links that connect all of the distinct fingerprints ``fp`` within ``BITS`` bits of each other.

    Groups agree on two of five blocks. The members of a group with more than ``split`` of them are grouped anew by
    five of eight blocks of the open bits; 49 or more bits then agree, which bounds such a group by 2^15 fingerprints.
    """
    first = stored(_together(_keyed(fps, _array(COARSE)), split), "links")
    large = first.where("way >= 0").select(F.col("a").alias("fp"), "way")
    fine = F.array(*(_array(m) for m in FINE))
    again = large.select("fp", F.col("way").alias("w"), fine[F.col("way").cast("int")].alias("masks"))
    again = again.select("fp", "w", F.posexplode("masks").alias("k", "mask")).select(
        (F.col("w") * 56 + F.col("k")).alias("way"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp"
    )
    return first.where("way < 0").select("a", "b").union(_together(again, None).select("a", "b"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) of every row.

    Texts are lower-cased (A-Z), cut into words, and hashed by three-word shingles; a null or empty text has
    fingerprint zero and is linked like any other. Equal fingerprints and those within three bits are linked, and
    ``component_id`` is the smallest doc_id that links lead to. Rows without doc_id count as members but never name
    a group; a group of only such rows has a null component_id. Repeated rows stay.
    """
    marked = stored(fingerprints(docs), "fingerprints")
    distinct = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    reached = components(links(distinct.select("fp")))
    rooted = distinct.join(reached, distinct.fp == reached.node, "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(smallest, "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def digest() -> Column:
    """Name of a text: equal for equal texts, null and empty ones alike."""
    return F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))


def roots(docs: DataFrame) -> DataFrame:
    """(key, root) of every different text: its digest, and one fingerprint for all that links lead to."""
    texts = docs.select(digest().alias("key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    marked = stored(_marked(texts).dropDuplicates(["key"]), "fingerprints")
    reached = components(links(marked.select("fp").distinct()))
    return marked.join(reached, marked.fp == reached.node, "left").select("key", F.coalesce("root", "fp").alias("root"))


def first_of_each(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` per group of near duplicates, that with the smallest (doc_id, digest of the text); all columns.

    Rows are told apart by doc_id and digest, so rows of unlike texts that share a doc_id all stay. A row without doc_id
    stays where no row of its group has one, and only one of them does. Of rows equal in both the smallest stays. Only
    names and digests are aggregated; whole rows meet the chosen ones in one join, whose key no two texts share.
    """
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), digest().alias("key"))
    names = stored(rows.groupBy("id", "key").agg(F.count("*").alias("n")), "names")
    firsts = names.groupBy("key").agg(F.min("id").alias("id"))
    grouped = firsts.join(roots(docs), "key").groupBy("root")
    first = grouped.agg(F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "key")).alias("first"))
    chosen = first.select(F.col("first.id").alias("i"), F.col("first.key").alias("k"))
    chosen = stored(chosen.join(names, (F.col("k") == names.key) & F.col("i").eqNullSafe(names.id)).select("i", "k", "n"), "chosen")
    found = rows.join(chosen, (rows.key == chosen.k) & rows.id.eqNullSafe(chosen.i))
    once = found.where("n = 1").select("row.*")
    return once.unionByName(found.where("n > 1").groupBy("id", "key").agg(F.min("row").alias("row")).select("row.*"))


def query(spark: SparkSession, folder: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{folder}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
