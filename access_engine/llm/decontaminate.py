"""Benchmark decontamination: containment search for short test items in long documents.

Items are parted by the size of their shingle set. Each part keeps, per item, the smallest hashes of its shingles (a
MinHash sketch) and as many of them as the part's size asks for: an item of n shingles that a document contains to a
share t misses at most (1 - t) n of them, so one of the floor((1 - t) n) + 1 smallest is in the document. Documents
probe the sketches with all their shingles, long texts too, so no contained item is missed; the share is then counted
on the shingles themselves.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from access_engine.llm.text import LOWER, WORD, mix, span_hashes, text_blocks, word_bounds

WIDTH = 5
SHARE = 0.8
#: Items that go to the tasks at once; more items make more passes.
ITEMS = 20_000
#: And bytes of their texts; an item longer than that makes a pass of its own.
BYTES = 8 << 20

_LOWER = LOWER.tobytes()
_RESULT = "doc_id long, item_id long, n_shingles long, n_found long, containment double"


def shingle_hashes(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words within a text, and the number of each run's first word."""
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.flatnonzero(owner[: len(owner) - width + 1] == owner[width - 1 :]) if len(words) >= width else np.zeros(0, int)
    key = np.zeros(len(at), np.uint64)
    for k in range(width):
        key = key * np.uint64(0x100000001B3) + words[at + k]
    return mix(key), at


class Sketches:
    """The items' shingles, and their sketches by shingle width and size part."""

    def __init__(self, items: list[tuple[int, bytes]], share: float):
        self.share = share
        self.items: list[tuple[int, set[bytes]]] = []
        self.width: list[int] = []
        keys: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for item_id, text in items:
            words = text.translate(_LOWER).split()
            if not words:
                continue
            width = min(WIDTH, len(words))
            shingles = {b" ".join(words[k : k + width]) for k in range(len(words) - width + 1)}
            data = np.frombuffer(b" ".join(words), np.uint8)
            starts, ends, _ = word_bounds(data, np.array([0, len(data)]))
            hashes = np.unique(shingle_hashes(span_hashes(data, starts, ends), np.array([0, len(words)]), width)[0])
            part = 1 << (len(shingles) - 1).bit_length()  # sizes in (part / 2, part]
            least = math.floor((1 - share) * part + 1e-9) + 1
            for h in hashes[:least].tolist():
                keys[width].append((h, len(self.items)))
            self.items.append((item_id, shingles))
            self.width.append(width)
        self.keys, self.bits = {}, {}
        for width, found in keys.items():
            table = np.array(sorted(found), np.uint64)
            bits = np.zeros(1 << 18, bool)
            bits[table[:, 0] & np.uint64(len(bits) - 1)] = True
            self.keys[width], self.bits[width] = table, bits

    def candidates(self, data: np.ndarray, offsets: np.ndarray) -> set[tuple[int, int]]:
        """(text, item) pairs that share a sketch hash."""
        starts, ends, first = word_bounds(data, offsets)
        words = span_hashes(data, starts, ends)
        out: set[tuple[int, int]] = set()
        for width, table in self.keys.items():
            hashes, at = shingle_hashes(words, first, width)
            near = np.flatnonzero(self.bits[width][hashes & np.uint64(len(self.bits[width]) - 1)])
            low, high = (np.searchsorted(table[:, 0], hashes[near], side) for side in ("left", "right"))
            for k in np.flatnonzero(high > low).tolist():
                text = int(np.searchsorted(first, at[near[k]], "right")) - 1
                out.update((text, int(item)) for item in table[low[k] : high[k], 1])
        return out

    def verified(self, text: bytes, items: list[int]) -> Iterator[tuple[int, int, int]]:
        """(item_id, shingles, of these in the text) where the text holds the wanted share."""
        words, seen = text.split(), {}
        for k in items:
            width = self.width[k]
            if width not in seen:
                seen[width] = {b" ".join(words[j : j + width]) for j in range(len(words) - width + 1)}
            item_id, shingles = self.items[k]
            found = len(shingles & seen[width])
            if found >= self.share * len(shingles) - 1e-9:
                yield item_id, len(shingles), found


def _batches(benchmark: DataFrame) -> Iterator[list[tuple[int, bytes]]]:
    """The items in runs of bounded number and size, one run at a time on the driver."""
    held, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).toLocalIterator():
        text = (row.text or "").encode()
        if held and (len(held) >= ITEMS or size + len(text) > BYTES):
            yield held
            held, size = [], 0
        held.append((row.item_id, text))
        size += len(text)
    yield held


def contained_items(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_found, containment): items of which a document holds ``share`` or more.

    Words are lower-cased (A-Z); an item's shingles are its distinct runs of five words, or the whole item if it has
    fewer; ``containment`` is the part of them that the document has anywhere. Items without words and null texts
    match nothing. Repeated documents or items give repeated rows. The benchmark goes to the tasks in runs of bounded
    size, each with one pass over the documents.
    """
    spark = docs.sparkSession
    given = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out = None
    for items in _batches(benchmark):
        held = spark.sparkContext.broadcast(Sketches(items, share))  # ITEMS and BYTES bound it

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            sketches = held.value
            for batch in batches:
                rows = []
                for low, _, data, offsets in text_blocks(batch.column("text")):
                    lower = LOWER[data]
                    by_text = defaultdict(list)
                    for text, item in sketches.candidates(lower, offsets):
                        by_text[text].append(item)
                    for text, some in by_text.items():
                        doc_id = batch.column("doc_id")[low + text]
                        for item_id, n, found in sketches.verified(lower[offsets[text] : offsets[text + 1]].tobytes(), some):
                            rows.append((doc_id.as_py(), item_id, n, found, found / n))
                columns = list(zip(*rows, strict=True)) or [()] * 5
                types = [pa.int64()] * 4 + [pa.float64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                    ["doc_id", "item_id", "n_shingles", "n_found", "containment"],
                )

        found = given.mapInArrow(run, _RESULT)
        out = found if out is None else out.union(found)
    return out


def without_items(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no item to the wanted share. Rows without doc_id are judged too."""
    spark = docs.sparkSession
    others = [c for c in docs.columns if c != "text"]
    out = docs.select(F.struct(*(F.col(f"`{c}`") for c in others)).alias("row"), F.col("text").cast("string"))
    for items in _batches(benchmark):
        held = spark.sparkContext.broadcast(Sketches(items, share))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            sketches = held.value
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for low, _, data, offsets in text_blocks(batch.column("text")):
                    lower = LOWER[data]
                    by_text = defaultdict(list)
                    for text, item in sketches.candidates(lower, offsets):
                        by_text[text].append(item)
                    for text, some in by_text.items():
                        whole = lower[offsets[text] : offsets[text + 1]].tobytes()
                        keep[low + text] = next(sketches.verified(whole, some), None) is None
                yield batch.filter(pa.array(keep))

        out = out.mapInArrow(run, out.schema)
    return out.select(*(F.col("text" if c == "text" else f"row.`{c}`") for c in docs.columns))


def query(spark: SparkSession, folder: str) -> DataFrame:
    read = spark.read.parquet
    return contained_items(read(f"{folder}/documents.parquet"), read(f"{folder}/benchmark.parquet"))


_WORDS = f"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}')"
SQL = f"""
WITH items AS (
  SELECT item_id, w, least({WIDTH}, len(w)) AS n FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0
), wanted AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS s
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM items)
), sizes AS (SELECT item_id, n, count(*) AS n_shingles FROM wanted GROUP BY ALL
), texts AS (SELECT doc_id, {_WORDS} AS w FROM documents
), there AS (
  SELECT DISTINCT doc_id, n, array_to_string(w[i : i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM texts, (SELECT DISTINCT n FROM items))
)
SELECT doc_id, item_id, n_shingles, count(*) AS n_found, count(*) / n_shingles AS containment
FROM there JOIN wanted USING (n, s) JOIN sizes USING (item_id, n)
GROUP BY doc_id, item_id, n_shingles
HAVING count(*) >= {SHARE} * n_shingles - 1e-9
"""
