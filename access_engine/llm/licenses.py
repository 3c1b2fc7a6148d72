"""Licence scans: a generalised suffix automaton of licence words, matching statistics, chains of long matches.

One automaton holds every stretch of every template. A file's words are read through it in one pass, which gives at each
word the longest stretch of some template that ends there. Matches that can't be prolonged are chained per template, in
order in the file and in the template with bounded gaps, and a chain that covers enough of its template is a span.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence
from functools import cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from access_engine.llm.text import LOWER, text_blocks

# Phrases and their labels, and notices as the licences' publishers word them.
PHRASES = (
    ("cc-by", "cc by"),
    ("gpl", "general public license"),
    ("reserved", "all rights reserved"),
)
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2.0"),
    (
        "apache-2.0",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at"
        " http://www.apache.org/licenses/LICENSE-2.0 unless required by applicable law or agreed to in writing software"
        " distributed under the license is distributed on an as is basis without warranties or conditions of any kind"
        " either express or implied see the license for the specific language governing permissions and limitations"
        " under the license",
    ),
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated"
        " documentation files the software to deal in the software without restriction including without limitation the"
        " rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit"
        " persons to whom the software is furnished to do so subject to the following conditions the above copyright"
        " notice and this permission notice shall be included in all copies or substantial portions of the software",
    ),
    (
        "mit",
        "the software is provided as is without warranty of any kind express or implied including but not limited to the"
        " warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the"
        " authors or copyright holders be liable for any claim damages or other liability whether in an action of"
        " contract tort or otherwise arising from out of or in connection with the software or the use or other dealings"
        " in the software",
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby"
        " granted provided that the above copyright notice and this permission notice appear in all copies",
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the"
        " following conditions are met redistributions of source code must retain the above copyright notice this list"
        " of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright"
        " notice this list of conditions and the following disclaimer in the documentation and or other materials"
        " provided with the distribution",
    ),
    (
        "bsd-3-clause",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote"
        " products derived from this software without specific prior written permission",
    ),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    (
        "gpl-notice",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public"
        " license as published by the free software foundation either version 3 of the license or at your option any"
        " later version",
    ),
    (
        "lgpl-notice",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general"
        " public license as published by the free software foundation either version 2.1 of the license or at your option"
        " any later version",
    ),
    (
        "mpl-2.0",
        "this source code form is subject to the terms of the mozilla public license v 2.0 if a copy of the mpl was not"
        " distributed with this file you can obtain one at https://mozilla.org/MPL/2.0/",
    ),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4.0 international license"),
    ("cc-by-sa-4.0", "this work is licensed under a creative commons attribution sharealike 4.0 international license"),
    ("cc-by-4.0", "licensed under cc by 4.0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4.0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4.0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    (
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held"
        " liable for any damages arising from the use of this software",
    ),
)

#: Words of a match that can be part of a chain, words between chained matches, and the share a span covers at least.
LONG = 3
GAP = 8
SHARE = 0.6

#: Letters in lower case, digits and bytes above 127 are words; all else parts them.
_WORDS = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in LOWER.tolist())

_PLACE = "array<struct<label: string, start: long, end: long>>"
_SPAN = "array<struct<label: string, start: long, end: long, words: long, share: double>>"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


class Automaton:
    """Every stretch of several word sequences; a state stands for the stretches that end at the same places."""

    def __init__(self, sequences: Sequence[Sequence[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        ends: list[list[tuple[int, int]]] = [[]]
        for number, sequence in enumerate(sequences):
            last = 0
            for place, word in enumerate(sequence):
                last = self._extend(last, word, ends)
                ends[last].append((number, place + 1))
        # Places of a state are also those of all states whose stretches end in its own.
        for state in sorted(range(1, len(self.size)), key=lambda s: -self.size[s]):
            if self.link[state] > 0:
                ends[self.link[state]] += ends[state]
        self.ends = [sorted(set(e)) for e in ends]

    def _state(self, size: int, after: dict[int, int], link: int, ends: list[list[tuple[int, int]]]) -> int:
        self.next.append(after)
        self.link.append(link)
        self.size.append(size)
        ends.append([])
        return len(self.size) - 1

    def _part(self, state: int, word: int, ends: list[list[tuple[int, int]]]) -> int:
        """The state of the stretches that ``word`` prolongs from ``state``, parted from longer ones."""
        old = self.next[state][word]
        if self.size[old] == self.size[state] + 1:
            return old
        new = self._state(self.size[state] + 1, dict(self.next[old]), self.link[old], ends)
        self.link[old] = new
        while state >= 0 and self.next[state].get(word) == old:
            self.next[state][word] = new
            state = self.link[state]
        return new

    def _extend(self, last: int, word: int, ends: list[list[tuple[int, int]]]) -> int:
        if word in self.next[last]:
            return self._part(last, word, ends)
        new = self._state(self.size[last] + 1, {}, 0, ends)
        state = last
        while state >= 0 and word not in self.next[state]:
            self.next[state][word] = new
            state = self.link[state]
        if state >= 0:
            self.link[new] = self._part(state, word, ends)
        return new

    def statistics(self, words: Sequence[int]) -> tuple[list[int], list[int]]:
        """For each word the longest stretch that ends there: its state and its number of words."""
        after, link, size = self.next, self.link, self.size
        state, length, states, lengths = 0, 0, [], []
        for word in words:
            while state and word not in after[state]:
                state = link[state]
                length = size[state]
            if word in after[state]:
                state = after[state][word]
                length += 1
            states.append(state)
            lengths.append(length)
        return states, lengths


class Scanner:
    """The automaton of templates and phrases, and what is found with it in a file's words."""

    def __init__(self, templates: Sequence[tuple[str, str]], phrases: Sequence[tuple[str, str]]):
        self.labels = [label for label, _ in (*templates, *phrases)]
        sequences = [words_of(text.encode()) for _, text in (*templates, *phrases)]
        if any(len(s) < 2 for s in sequences):
            raise ValueError("templates and phrases have two words or more")
        self.sizes = [len(s) for s in sequences]
        self.first_phrase = len(templates)
        self.number = {word: k for k, word in enumerate(sorted(set(chain.from_iterable(sequences))))}
        self.unknown = len(self.number)
        numbered = [[self.number[w] for w in s] for s in sequences]
        self.automaton = Automaton(numbered)
        #: Pairs of words that stand together in some template; matches of two words and more are made of these.
        self.pair = np.zeros((self.unknown + 1, self.unknown + 1), bool)
        for s in numbered:
            self.pair[s[:-1], s[1:]] = True
        # Phrases that the stretches of a state end in, with their words; a match as long as the phrase holds it.
        self.phrases = self._phrases()

    def _phrases(self) -> list[list[tuple[int, int]]]:
        automaton = self.automaton
        held: list[list[tuple[int, int]]] = [[] for _ in automaton.size]
        for state in sorted(range(1, len(held)), key=lambda s: automaton.size[s]):
            link = automaton.link[state]
            own = [
                (number, end)
                for number, end in automaton.ends[state]
                if number >= self.first_phrase and automaton.size[link] < end == self.sizes[number] <= automaton.size[state]
            ]
            held[state] = held[link] + own
        return held

    def scan(self, words: list[int], start: int) -> tuple[list[tuple[int, int]], list[tuple[int, int, int, int]]]:
        """Phrases as (number, start) and maximal matches as (template, its end there, end, words) of one stretch."""
        states, lengths = self.automaton.statistics(words)
        places, matches = [], []
        for k, (state, length) in enumerate(zip(states, lengths, strict=True)):
            places += [(n, start + k + 1 - size) for n, size in self.phrases[state] if size <= length]
            if length >= LONG and (k + 1 == len(words) or lengths[k + 1] <= length):
                matches += [(n, end, start + k + 1, length) for n, end in self.automaton.ends[state] if n < self.first_phrase]
        return places, matches

    def spans(self, matches: list[tuple[int, int, int, int]]) -> list[dict]:
        """Chains that cover enough of a template; of those that overlap, the ones that cover most words."""
        found = []
        by_template: dict[int, list[tuple[int, int, int]]] = {}
        for number, there, end, length in matches:
            by_template.setdefault(number, []).append((end, there, length))
        for number, own in by_template.items():
            best = self._chains(sorted(own))
            size = self.sizes[number]
            found += [
                {"label": self.labels[number], "start": a, "end": b, "words": n, "share": n / size}
                for a, b, n in best
                if n >= SHARE * size
            ]
        return _strongest(found)

    @staticmethod
    def _chains(matches: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """(start, end, words covered) of the best chain from every match that none precedes."""
        best: dict[int, tuple[int, int, int]] = {}
        ends = [end for end, _, _ in matches]
        chains: list[tuple[int, int, int]] = []  # words covered, start, first match
        for k, (end, there, length) in enumerate(matches):
            score, start, root = length, end - length, k
            for j in range(bisect_left(ends, end - length - GAP), k):
                gained = min(length, end - ends[j], there - matches[j][1])
                if gained > 0 and there - length - matches[j][1] <= GAP and chains[j][0] + gained > score:
                    score, start, root = chains[j][0] + gained, *chains[j][1:]
            chains.append((score, start, root))
            if root not in best or best[root][2] < score:
                best[root] = (start, end, score)
        return list(best.values())


def _strongest(spans: list[dict]) -> list[dict]:
    """Spans by start, without those that overlap one that covers more words; equal ones stay."""
    spans = sorted(spans, key=lambda s: (s["start"], s["end"], s["label"]))
    kept: list[dict] = []
    group: list[dict] = []
    reach = -1
    for span in [*spans, None]:
        if span is None or span["start"] >= reach:
            taken: list[dict] = []
            for one in sorted(group, key=lambda s: -s["words"]):
                if all(
                    one["end"] <= t["start"] or t["end"] <= one["start"] or one["words"] == t["words"] for t in taken
                ) and one not in taken:
                    taken.append(one)
            kept += sorted(taken, key=lambda s: (s["start"], s["end"], s["label"]))
            group = []
        if span is not None:
            group.append(span)
            reach = max(reach, span["end"])
    return kept


@cache
def scanner(templates: tuple[tuple[str, str], ...], phrases: tuple[tuple[str, str], ...]) -> Scanner:
    return Scanner(templates, phrases)


def _scanned(known: Scanner, ids: pa.Array, texts: list[list[bytes]]) -> pa.RecordBatch:
    bounds = np.cumsum([0, *map(len, texts)])
    numbers = np.fromiter(
        map(known.number.get, chain.from_iterable(texts), repeat(known.unknown)), np.int64, int(bounds[-1])
    )
    held = np.zeros(len(numbers) + 1, bool)  # this word and the one before stand together in a template
    if len(numbers):
        held[1:-1] = known.pair[numbers[:-1], numbers[1:]]
    held[bounds] = False
    step = np.diff(held.astype(np.int8))
    firsts, lasts = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    owner = np.searchsorted(bounds, firsts, "right") - 1
    places: list[list[dict]] = [[] for _ in texts]
    matches: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
    for first, last, t in zip(firsts.tolist(), lasts.tolist(), owner.tolist(), strict=True):
        found, more = known.scan(numbers[first : last + 1].tolist(), first - int(bounds[t]))
        places[t] += [{"label": known.labels[n], "start": at, "end": at + known.sizes[n]} for n, at in found]
        matches[t] += more
    place = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    span = pa.list_(
        pa.struct(
            [("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("words", pa.int64()), ("share", pa.float64())]
        )
    )
    spans = [known.spans(m) if m else [] for m in matches]
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(np.diff(bounds)), pa.array(places, place), pa.array(spans, span)],
        ["doc_id", "n_words", "places", "spans"],
    )


def scan(
    docs: DataFrame,
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    phrases: Sequence[tuple[str, str]] = PHRASES,
) -> DataFrame:
    """(doc_id, n_words, places, spans) of every row of ``docs``; places and spans count words from 0, end exclusive.

    Texts are lower-cased (A-Z) and cut into words of letters, digits and characters beyond ASCII. ``places`` are all
    places of ``phrases`` as (label, start, end). ``spans`` are stretches (label, start, end, words, share) that cover at
    least ``SHARE`` of a template's words by matches of ``LONG`` words or more with at most ``GAP`` other words between
    two of them; of spans that overlap those with most words stay, equal ones all do. Null and empty texts have no
    words; repeated rows are each searched, and a row without doc_id like any other. A text is worked on whole.
    """
    templates, phrases = tuple(map(tuple, templates)), tuple(map(tuple, phrases))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = scanner(templates, phrases)
        for batch in batches:
            for low, high, data, offsets in text_blocks(batch.column("text")):
                held, cuts = data.tobytes(), offsets.tolist()
                texts = [words_of(held[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield _scanned(known, batch.column("doc_id").slice(low, high - low), texts)

    schema = f"doc_id long, n_words long, places {_PLACE}, spans {_SPAN}"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def labelled(found: DataFrame) -> DataFrame:
    """Counts and labels of a scan: the columns of the registered query.

    ``score`` is the largest share of a template or phrase that is covered, so 1 where a phrase stands.
    """
    places, spans = F.col("places"), F.col("spans")
    base = F.array_sort(F.array_distinct(places["label"]))
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(places["start"]).alias("first_word"),
        F.array_max(places["start"]).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(places["label"], spans["label"])), ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(F.array_max(spans["share"]), F.lit(0.0))).alias("score"),
    )


def query(spark: SparkSession, folder: str) -> DataFrame:
    return labelled(scan(spark.read.parquet(f"{folder}/documents.parquet")))
