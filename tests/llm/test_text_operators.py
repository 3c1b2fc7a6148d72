"""Quality, personal data, tokens, chat and repeats against brute force and on odd input."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from access_engine.llm import chat, pii, quality, repeats, text, tokens

SCHEMA = "doc_id long, text string, lang string, source string, score double, row string, size long, key string"
FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns that clash with those the operators make."""
    rows = [
        (1, "a plain text of some words .", "en", "s", 0.5, "r", 1, "k"),
        (1, "a plain text of some words .", "en", "s", 0.5, "r", 1, "k"),
        (2, None, None, None, None, None, None, None),
        (3, "", "en", "s", 0.1, "r", 2, "k"),
        (None, "no id at all", "en", None, 0.2, "r", 3, "k"),
        (4, "word " * 60_000 + "é", "en", "t", 0.3, "r", 4, "k"),
        (5, " \t\n ", "en", "t", 0.3, "r", 4, "k"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_hashes_tell_words_apart():
    data = np.frombuffer(b"one two one three two", np.uint8)
    starts, ends, first = text.word_bounds(data, np.array([0, 8, 8, len(data)]))
    found = text.span_hashes(data, starts, ends)
    assert first.tolist() == [0, 2, 2, 5]
    assert found[0] == found[2] and found[1] == found[4] and len(set(found.tolist())) == 3
    assert len(set(repeats.gram_hashes(np.frombuffer(bytes(range(200)) * 2, np.uint8), 16).tolist())) == 200


def test_quality_learns_tables_and_pairs():
    rng = np.random.default_rng(3)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)  # only a pair of features tells
    model = quality.fit(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.95
    assert (quality.fit(x[:0], y[:0]).score(x[:5]) == 0.5).all()


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.score_documents(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.9
    assert all(r.predicted == 1 for r in rows if r.quality == 1)


def test_quality_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    found = quality.score_documents(odd, labels)
    assert found.count() == 7 and found.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert quality.score_documents(odd, labels.limit(0)).where("score = 0.5").count() == 7
    assert quality.score_documents(odd.limit(0), labels).count() == 0
    assert quality.keep_good(odd, labels, 0.0).columns == odd.columns
    assert quality.keep_good(odd, labels, 0.0).exceptAll(odd).count() == 0


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(t):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(t) if 13 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(t) if 9 <= len(digits(m)) <= 15]


def test_patterns_equal_plain_search():
    rng = random.Random(1)
    for _ in range(20_000):
        t = "".join(rng.choice("01234567890123456789..@@ab+- ()é%_") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(t) == plain_spans(t)


def test_field_adds_and_keeps():
    field = pii.train()
    known, every = pii.all_spans(["tel 040-7654321 and 4283648832092189 was.91@mail6.example.com"], field)[0]
    assert set(known) <= set(every) and ("phone", 4, 15) in every
    for line in pii.SENTENCES:
        words, tags = pii._labelled(line)
        assert field.decode([words])[0].tolist() == tags
    assert pii.all_spans(["order 9890149938096989 in 2019 , page 12"], field)[0][1] == []


#: Sentences that the training table does not hold.
HELD = [
    "you can phone me on [phone|0171 555 8821] after lunch",
    "mobile [phone|0912-443-1187] or the desk at [phone|020 7946 0018]",
    "our fax is [phone|(030) 4455 667] in the old town",
    "contact [phone|555-201-7788] , room 12",
    "ring [phone|06221-778899] before 9 in the morning",
    "tel: [phone|089/1234567] and ask for Ann",
    "paid with card [card|4111 1111 1111 1111] on 3 May 2021",
    "send it to [email|j.smith@example.org] by Friday",
    "the host [ip|10.20.30.40] answered in 35 ms",
    "call [phone|0800 123 4567] free of charge",
    "in 2019 we sold 12500 units for 399.99 each",
    "version 1.2.3 was built on 2020-11-05 at 14:30",
    "page 315 of 1200 , chapter 7 , section 4.2",
    "order 20230418-77 was shipped with 3 boxes",
    "the score was 24-17 after 60 minutes",
    "population 8,405,837 in 2013 and 8.8 million in 2020",
    "flight 447 left gate 12 at 18:05",
    "ISBN 978-3-16-148410-0 has 448 pages",
    "the room costs 120 to 150 euros a night",
    "write to her at [email|ann.b@mail.example.net] or reach [phone|(212) 555-0199]",
]


def unseen(line):
    """Text of a labelled line, and its spans."""
    words, tags = pii._labelled(line)
    starts = np.cumsum([0, *(len(w) + 1 for w in words)]).tolist()
    cuts = [k for k in range(len(words) + 1) if k in (0, len(words)) or tags[k] != tags[k - 1]]
    spans = [(pii.TAGS[tags[a]], starts[a], starts[b] - 1) for a, b in zip(cuts, cuts[1:], strict=False) if tags[a]]
    return " ".join(words), spans


def test_field_on_unseen_sentences():
    field, right, wrong, missed = pii.train(), 0, 0, 0
    for line in HELD:
        text, wanted = unseen(line)
        base, every = (set(x) for x in pii.all_spans([text], field)[0])
        assert base <= every
        added, open_ = every - base, set(wanted) - base
        right, wrong, missed = right + len(added & open_), wrong + len(added - open_), missed + len(open_ - added)
    assert right >= 8 and wrong == 0 and missed <= 1


def test_long_words_reach_the_field_whole():
    """Nothing of a word is cut off: what stands far inside it shapes its features."""
    assert pii._own("x" * 500 + "-12345") != pii._own("x" * 500) and pii._near("x" * 500 + "7") == "0"


def test_viterbi_finds_the_best_path():
    field = pii.train()
    words = "call 555-123-4567 in 2019 now".split()
    emit, best = field.scores(words), -np.inf
    for tags in np.ndindex(*[len(pii.TAGS)] * len(words)):
        score = emit[range(len(words)), tags].sum() + field.first[tags[0]] + sum(field.moves[a, b] for a, b in zip(tags, tags[1:], strict=False))
        if score > best:
            best, path = score, tags
    assert field.decode([words, words[:2]])[0].tolist() == list(path)


def test_personal_data_odd_rows(odd):
    found = pii.find_personal_data(odd)
    assert found.count() == 7 and found.where(F.size("spans") > 0).count() == 0
    assert pii.find_personal_data(odd.limit(0)).count() == 0


def test_token_counts_equal_the_library(spark, odd):
    loaded, safe = tokens._tokenizer(None)
    assert safe
    rng = random.Random(2)
    for _ in range(300):
        t = "".join(rng.choice("ab  \n▁é語0 the ") for _ in range(rng.randint(0, 60)))
        assert sum(map(len, loaded.encode(tokens.pieces(t, 5)))) == len(loaded.encode(t)), repr(t)
    found = tokens.token_counts(odd).collect()
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    assert len(found) == 7
    assert all((r.n_tokens, r.n_bytes) == (len(loaded.encode(texts[r.doc_id])), len(texts[r.doc_id].encode())) for r in found)
    assert {r.doc_id for r in found if r.over_limit} == {4}
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    counts = {r.doc_id: r.n_tokens for r in tokens.token_counts(docs).collect()}
    assert all(counts[r.doc_id] == len(loaded.encode(r.text)) for r in docs.collect())


def test_chat_round_trip(spark):
    rows = [
        (1, 2, "assistant", "two <|im_end|> <\\|x"),
        (1, 1, "user", "one"),
        (1, 3, "assistant", "three <|im_sep|>"),
        (1, 3, "assistant", "three <|im_sep|>"),
        (2, 1, None, None),
        (2, None, "system\nx<|", "\n"),
        (None, 1, "assistant", "nobody's"),
    ]
    said = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, turns string")
    found = {r.conv_id: r for r in chat.read_back(chat.formatted(said)).collect()}
    assert [tuple(t) for t in found[1].turns] == [("user", "one"), *[(r[2], r[3]) for r in rows if r[0] == 1 and r[1] > 1]]
    assert [tuple(t) for t in found[2].turns] == [("system\nx<|", "\n"), ("", "")]
    assert found[1].formatted.count(chat.START) == 2 and found[1].formatted.count(chat.SEP) == 2
    assert [s.text for s in found[1].segments if s.loss] == ["two <\\|im_end|> <\\\\|x", *["three <\\|im_sep|>"] * 2]
    assert "".join(s.text for s in found[1].segments) == found[1].formatted
    assert found[None].turns[0].text == "nobody's"
    assert chat.formatted(said.limit(0)).count() == 0


def brute_repeats(rows, keep_first):
    """Removed runs by comparing all windows; rows are (doc_id, text), sorted by doc_id."""
    seen, texts = defaultdict(list), [(t or "").encode() for _, t in rows]
    for k, data in enumerate(texts):
        for p in range(len(data) - repeats.LENGTH + 1):
            seen[data[p : p + repeats.LENGTH]].append((k, p))
    covered = [bytearray(len(t)) for t in texts]
    for places in seen.values():
        for k, p in places[1:] if keep_first else places if len(places) > 1 else []:
            covered[k][p : p + repeats.LENGTH] = b"\1" * repeats.LENGTH
    return {
        d: (sum(c), hashlib.sha256(bytes(x for x, gone in zip(t, c, strict=True) if not gone)).hexdigest())
        for (d, _), t, c in zip(rows, texts, covered, strict=True)
    }


@pytest.mark.parametrize("limit", [repeats.GROUP_BYTES, 600])
@pytest.mark.parametrize("keep_first", [True, False])
def test_repeats_equal_brute_force(spark, monkeypatch, limit, keep_first):
    monkeypatch.setattr(repeats, "GROUP_BYTES", limit)
    rng = random.Random(5)
    filler = lambda n: "".join(rng.choice("abcdé \x00") for _ in range(n))
    passage, other = filler(700), filler(399)
    rows = [(k, filler(rng.randint(0, 300)) + passage[rng.randint(0, 200) :] + filler(rng.randint(0, 300))) for k in range(12)]
    rows += [(20, rows[3][1]), (21, passage * 3), (22, "z" * 2000), (23, "z" * 399), (24, other), (25, "x" + other), (26, None), (27, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = repeats.without_repeats(docs, keep_first).collect()
    wanted = brute_repeats(rows, keep_first)
    assert {r.doc_id: (sum(s.end - s.start for s in r.spans), r.sha256) for r in found} == wanted
    assert sum(v[0] > 0 for v in wanted.values()) > 10


def test_repeats_odd_rows(odd):
    found = {r.doc_id: r for r in repeats.without_repeats(odd).collect()}
    assert len(found) == 6 and found[2].n_bytes == 0
    assert [tuple(s) for s in found[4].spans] == [(5, 300_000)]  # a text that repeats itself keeps its first word
    assert repeats.without_repeats(odd.limit(0)).count() == 0


def test_longest_previous_factor():
    data = np.frombuffer(b"ab" * 300 + b"x" * 500, np.uint8)
    starts = np.arange(len(data) - repeats.LENGTH + 1)
    found = repeats.SuffixOrder(data, starts).longest()
    for p in (0, 1, 2, 3, 150, 199, 200, 201, 350, 600, 601, 700):
        near = [next((k for k in range(repeats.LENGTH) if data[q + k] != data[p + k]), repeats.LENGTH) for q in range(p)]
        assert found[p] == max(near, default=0)


def test_text_view_of_null_rows():
    data, offsets = text.byte_view(pa.array(["a", None, "bc"]).slice(1))
    assert np.diff(offsets).tolist() == [0, 2] and data[offsets[1] : offsets[2]].tobytes() == b"bc"
