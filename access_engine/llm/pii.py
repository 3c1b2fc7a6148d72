"""Personal data: patterns with checks, and a linear-chain conditional random field that adds what they miss.

The field labels words by their shapes and those of their neighbours; it is fitted to a small table of labelled
sentences and decoded by Viterbi over many stretches at once. A stretch is the words around one with a digit or an at
sign; other words are outside by definition, so texts without such a word cost one look at their bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from access_engine.llm.text import byte_view

KINDS = ("email", "ip", "card", "phone")
TAGS = ("outside", *KINDS)
REACH = 3

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_TRIGGER = np.zeros(256, bool)
_TRIGGER[list(b"0123456789@")] = True


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches at each at sign in turn: all local characters to its left, then the longest domain."""
    done, at = 0, text.find("@")
    while at != -1:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield start, done
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind and start: leftmost matches that pass their kind's check."""
    out = [("email", a, b) for a, b in _emails(text)]
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if len(m[0]) <= 37 and 13 <= len(digits := re.sub("[ -]", "", m[0])) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_DIGIT.findall(m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


# Labelled sentences, the whole training table: a span stands in brackets with its kind before a bar.
SENTENCES = """
please write to [email|anna.bell@example.org] soon .
my mail is [email|tom_3@mail.example.com] , thanks
contact [email|info@shop-online.example.net] for more
send it to [email|bo@localhost] or call
reach me under [email|li.wu@intranet] today
the server at [ip|10.0.0.12] went down
from [ip|192.168.1.254] to [ip|172.16.30.9] now
host [ip|8.8.4.4:53] answered twice
ping [ip|203.0.113.77] and wait
paid with card [card|4111 1111 1111 1111] yesterday
card number [card|5500-0000-0000-0004] expired
the card [card|340000000000009] was refused
visa [card|4012888888881881] please
call me at [phone|555-123-4567] tonight
phone [phone|(068) 555 12 34] or later
tel [phone|030-1234567] office
phone : [phone|555.867.5309] home
my phone is [phone|+49 30 1234567] at work
tel [phone|+1 (202) 555-0147] after six
call [phone|0171-5551234] or [phone|0172-5554321] now
in 2019 there were 345 of them
on 12.05.2021 and on 2020-11-03 it rained
version 1.2.3 and 4.10 were tested
it cost 1,299.00 or $12.50 in all
page 12 to 45 of chapter 3
token = "2100a60029d9170a161913d4d019930026318f5d" end
at 12:30 or 18:45:10 every day
order 9890149938096989 was shipped
number 1234567890123456 is not valid
item 4283648832092189 in store
the ratio is 3.14159 to 1
section 2.3.4 of part 7
about 100-200 people came
see @anna and @tom there
pi @ 5 or 6 each
call 3 people at 10 o'clock
phone model 3310 is old
room 101 , floor 5
key 8f14e45fceea167a5a36dedad4bea254 here
they won 3-2 and 10-0 at home
born 1999-12-31 in 90210 town
id 000123456789 of 2021
phone me on [phone|0151 222 3344] any day
tel [phone|0161 496 0753] desk
my number is [phone|0207 946 0999] .
fax [phone|(040) 333 2211] office
call [phone|(089) 1234 567] again
mobile [phone|0176 1234567] or mail
the hotline [phone|0800 555 0000] is free
ring [phone|06131/445566] today
invoice 20210915-12 was paid
order 20191224-03 is late
case 2020-1187 is closed
between 1200 and 1500 people
sold 4500 units for 2999 each
article 4711-22 is sold out
the sum of 120 450 and 800 points
in 1998 , 2004 and 2011
""".strip().splitlines()


def _labelled(line: str) -> tuple[list[str], list[int]]:
    """Words and their tags."""
    words, tags = [], []
    for part in re.split(r"(\[[a-z]+\|[^\]]*\])", line):
        kind, bar, inner = part[1:-1].partition("|")
        span = part[:1] == "[" and bar
        for word in (inner if span else part).split():
            words.append(word)
            tags.append(TAGS.index(kind) if span else 0)
    return words, tags


def _shape(word: str) -> str:
    """Letters as a, digits as 0; runs of letters are one, runs of over four digits are five."""
    out = re.sub(r"[^\W\d_]+", "a", word)
    out = re.sub(r"[0-9]", "0", out)
    return re.sub(r"0{5,}", "00000", out)


def _own(word: str) -> list[str]:
    bare = word.strip(".,;:!?\"'()[]<>")
    digits = re.sub(r"[^0-9]", "", bare)
    parts = bare.split(".")
    octets = len(parts) == 4 and all(p[:4].isascii() and p[:4].isdigit() and len(p) < 4 and int(p) < 256 for p in parts)
    return [
        f"shape={_shape(bare)}",
        f"digits={min(len(digits), 20)}",
        f"letters={any(c.isalpha() for c in bare)}",
        f"at={bare.count('@') and (1 + (0 < bare.find('@') < len(bare) - 1))}",
        f"octets={octets}",
        f"card={13 <= len(digits) <= 19 and len(digits) == len(bare) and luhn(digits)}",
        f"signs={''.join(sorted(set(re.sub(r'[^-+().:/]', '', word))))}",
        f"first={word[:1] if word[:1] in '+(' else ''}",
    ]


_CUES = frozenset("call phone tel mail card visa contact fax mobile host server ping from to at write reach".split())


def _near(word: str) -> str:
    low = word.strip(".,;:").lower()
    return low if low in _CUES else ("0" if _DIGIT.search(word) else "a")


def observations(words: list[str]) -> list[list[str]]:
    """Feature names of every word of a stretch."""
    own, near = [_own(w) for w in words], [_near(w) for w in words]
    edge = ["|"] + near + ["|"]
    sizes = [f"beside={_shape(w.strip('.,;:'))}" if _DIGIT.search(w) else "" for w in words]
    out = []
    for k, names in enumerate(own):
        row = [*names, f"before={edge[k]}", f"after={edge[k + 2]}"]
        row += [f"{s}{sizes[k + s]}" for s in (-1, 1) if 0 <= k + s < len(words) and sizes[k + s]]
        out.append(row)
    return out


@dataclass
class Field:
    """Weights by feature and tag, by tag and next tag, and of first tags."""

    names: dict[str, int]
    weights: np.ndarray
    moves: np.ndarray
    first: np.ndarray

    def scores(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(TAGS)))
        for k, row in enumerate(observations(words)):
            known = [self.names[n] for n in row if n in self.names]
            out[k] = self.weights[known].sum(0)
        return out

    def decode(self, stretches: list[list[str]]) -> list[np.ndarray]:
        """Best tags of every stretch; stretches of like length go through Viterbi together."""
        out: list[np.ndarray] = [np.zeros(0, int)] * len(stretches)
        order = sorted(range(len(stretches)), key=lambda k: len(stretches[k]))
        for low in range(0, len(order), 256):
            some = order[low : low + 256]
            longest = len(stretches[some[-1]])
            emit = np.zeros((longest, len(some), len(TAGS)))
            lengths = np.array([len(stretches[k]) for k in some])
            for column, k in enumerate(some):
                emit[: lengths[column], column] = self.scores(stretches[k])
            back = np.zeros((longest, len(some), len(TAGS)), np.int8)
            best = emit[0] + self.first
            ends = best.copy()
            for t in range(1, longest):
                through = best[:, :, None] + self.moves
                back[t] = through.argmax(1)
                best = through.max(1) + emit[t]
                ends[lengths == t + 1] = best[lengths == t + 1]
            for column, k in enumerate(some):
                tags = np.zeros(lengths[column], int)
                tags[-1] = ends[column].argmax()
                for t in range(lengths[column] - 1, 0, -1):
                    tags[t - 1] = back[t, column, tags[t]]
                out[k] = tags
        return out


def train(sentences: list[str] = SENTENCES, steps: int = 250, rate: float = 0.3, penalty: float = 0.02) -> Field:
    """Fit by gradient steps on the conditional likelihood of all sentences at once."""
    table = [_labelled(line) for line in sentences]
    seen = [observations(words) for words, _ in table]
    names = {n: k for k, n in enumerate(sorted({n for rows in seen for row in rows for n in row}))}
    count, longest, tags = len(table), max(len(w) for w, _ in table), len(TAGS)
    x = np.zeros((count, longest, len(names)))
    y = np.zeros((count, longest), int)
    there = np.zeros((count, longest), bool)
    for i, rows in enumerate(seen):
        for t, row in enumerate(rows):
            x[i, t, [names[n] for n in row]] = 1
            y[i, t], there[i, t] = table[i][1][t], True
    gold = np.eye(tags)[y] * there[:, :, None]
    step_gold = np.einsum("ita,itb->ab", gold[:, :-1], gold[:, 1:])
    field = Field(names, np.zeros((len(names), tags)), np.zeros((tags, tags)), np.zeros(tags))
    sums = [np.full_like(p, 1e-8) for p in (field.weights, field.moves, field.first)]

    def lse(a: np.ndarray, axis: int) -> np.ndarray:
        top = a.max(axis, keepdims=True)
        return (np.log(np.exp(a - top).sum(axis, keepdims=True)) + top).squeeze(axis)

    for _ in range(steps):
        emit = x @ field.weights
        ahead, behind = np.zeros_like(emit), np.zeros_like(emit)
        ahead[:, 0] = emit[:, 0] + field.first
        for t in range(1, longest):
            now = lse(ahead[:, t - 1, :, None] + field.moves, 1) + emit[:, t]
            ahead[:, t] = np.where(there[:, t, None], now, ahead[:, t - 1])
        whole = lse(ahead[:, -1], 1)
        for t in range(longest - 2, -1, -1):
            now = lse(field.moves + (emit[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
            behind[:, t] = np.where(there[:, t + 1, None], now, 0)
        share = np.exp(ahead + behind - whole[:, None, None]) * there[:, :, None]
        pair = ahead[:, :-1, :, None] + field.moves + (emit[:, 1:] + behind[:, 1:])[:, :, None, :]
        pair = np.exp(pair - whole[:, None, None, None]) * there[:, 1:, None, None]
        slopes = (
            np.einsum("itf,ita->fa", x, gold - share) - penalty * field.weights,
            step_gold - pair.sum((0, 1)) - penalty * field.moves,
            (gold - share)[:, 0].sum(0) - penalty * field.first,
        )
        for part, slope, total in zip((field.weights, field.moves, field.first), slopes, sums, strict=True):
            total += slope**2
            part += rate * slope / np.sqrt(total)
    return field


def _stretches(words: list[re.Match]) -> Iterator[tuple[int, int]]:
    """Runs of words within ``REACH`` of one with a digit or an at sign."""
    hits = [k for k, w in enumerate(words) if "@" in w[0] or _DIGIT.search(w[0])]
    start = end = None
    for k in hits:
        if end is not None and k - REACH <= end:
            end = min(len(words), k + REACH + 1)
        else:
            if end is not None:
                yield start, end
            start, end = max(0, k - REACH), min(len(words), k + REACH + 1)
    if end is not None:
        yield start, end


def all_spans(texts: list[str], field: Field) -> list[tuple[list, list]]:
    """For each text its base spans, and those with the field's: tagged words that no base span touches."""
    base = [base_spans(t) for t in texts]
    words = [list(_WORD.finditer(t)) for t in texts]
    where = [(k, a, b) for k, found in enumerate(words) for a, b in _stretches(found)]
    tagged = field.decode([[m[0] for m in words[k][a:b]] for k, a, b in where])
    more: list[list] = [[] for _ in texts]
    for (k, a, _), tags in zip(where, tagged, strict=True):
        t = 0
        while t < len(tags):
            end = t + 1
            while end < len(tags) and tags[end] == tags[t]:
                end += 1
            if tags[t]:
                # Punctuation around a span is not part of it, but for the bracket that a phone number may open with.
                first, last = words[k][a + t], words[k][a + end - 1]
                start = first.end() - len(first[0].lstrip(".,;:!?\"'<>[]"))
                stop = last.start() + len(last[0].rstrip(".,;:!?\"'()<>[]"))
                if stop > start:
                    more[k].append((TAGS[tags[t]], start, stop))
            t = end
    out = []
    for known, extra in zip(base, more, strict=True):
        known_sorted = sorted(known, key=lambda s: s[1])
        starts = np.array([s[1] for s in known_sorted])
        reach = np.maximum.accumulate([s[2] for s in known_sorted]) if known_sorted else starts
        kept = []
        for kind, a, b in extra:
            before = np.searchsorted(starts, b) - 1  # the last base span that starts before the end
            if before < 0 or reach[before] <= a:
                kept.append((kind, a, b))
        out.append((known, sorted([*known, *kept], key=lambda s: (KINDS.index(s[0]), s[1]))))
    return out



def find_personal_data(docs: DataFrame, sentences: list[str] = SENTENCES) -> DataFrame:
    """(doc_id, base, spans) of every row of ``docs``: lists of (kind, start, end) in code points.

    ``base`` has the pattern matches, ``spans`` these and the field's. A null text is empty and has none; repeated
    rows are each searched.
    """
    field = train(sentences)
    span = "array<struct<kind: string, start: long, end: long>>"
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    names = ("kind", "start", "end")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = byte_view(batch.column("text"))
            marks = np.concatenate([[0], np.cumsum(_TRIGGER[data[offsets[0] : offsets[-1]]], dtype=np.int64)])
            hits = np.flatnonzero(np.diff(marks[offsets - offsets[0]]))
            base: list[list] = [[] for _ in range(batch.num_rows)]
            every: list[list] = [[] for _ in range(batch.num_rows)]
            for low in range(0, len(hits), 64):
                some = hits[low : low + 64].tolist()
                texts = [data[offsets[k] : offsets[k + 1]].tobytes().decode() for k in some]
                for k, (known, found) in zip(some, all_spans(texts, field), strict=True):
                    base[k] = [dict(zip(names, s, strict=True)) for s in known]
                    every[k] = [dict(zip(names, s, strict=True)) for s in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(base, kind), pa.array(every, kind)], ["doc_id", "base", "spans"]
            )

    given = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return given.mapInArrow(run, f"doc_id long, base {span}, spans {span}")


def query(spark: SparkSession, folder: str) -> DataFrame:
    found = find_personal_data(spark.read.parquet(f"{folder}/documents.parquet"))

    def said(column: str):
        one = F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
        return F.array_join(one, ",")

    def of(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    digest = F.sha2(said("base").cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", *map(of, KINDS), digest, said("spans").alias("spans"))
