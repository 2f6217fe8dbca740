import random

import pytest
from hypothesis import given, settings, strategies as st

from chronolith.llm import tokenize as T

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library(vocabulary):
    t = tokenizers.Tokenizer.from_file(vocabulary)
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


@pytest.fixture(scope="module")
def mine(vocabulary):
    return T.Encoder(vocabulary)


HARD = ["", " ", "\n\n\n x", "a" * 5000, " " * 3000 + "x", "=" * 700, "<|endoftext|>", "'s 'S ’s", "é é é", "漢字かな交じり文", "ภาษาไทยไม่มีช่องว่าง", "𠮷野家 🦜🏽‍🔬", "­soft­hyphen", "１２３ ١٢٣ 123", "​﻿\x00\x07", "Ünïcödé" * 200]


def test_hard_texts(mine, library):
    assert [list(x) for x in mine.encode_batch(HARD)] == library(HARD)


def test_random_mixtures(mine, library):
    r = random.Random(7)
    parts = ["the", " the", "ing", "tion", " ", "  ", "\n", "\t", "0", "42", ".", "...", "é", "ü", "漢", "ไ", "ก็", "🦜", "'re", "A", "ZZ", "_", "́", "­", "ß", "İ", "　"]
    texts = ["".join(r.choices(parts, k=r.randrange(80))) for _ in range(5000)]
    assert [list(x) for x in mine.encode_batch(texts)] == library(texts)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_any_text(text):
    enc = T.encoder(T.VOCABULARY)
    lib = tokenizers.Tokenizer.from_file(T.VOCABULARY)
    lib.encode_special_tokens = True
    try:
        text.encode()
    except UnicodeEncodeError:
        return
    assert [list(x) for x in enc.encode_batch([text])] == [lib.encode(text, add_special_tokens=False).ids]


def test_cache_starts_afresh(vocabulary, library, monkeypatch):
    monkeypatch.setattr(T, "CACHE_WORDS", 50)
    enc = T.Encoder(vocabulary)
    texts = [f"word{i} other{i % 7} {i * i}" for i in range(400)]
    out = [list(x) for t in texts for x in enc.encode_batch([t])]
    assert out == library(texts)
    assert len(enc.words) < 200


def test_over_spark(spark, library):
    rows = [(i, t, [9]) for i, t in enumerate(HARD)] + [(90, None, None), (91, "twice", None), (91, "twice", None), (None, "no id", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids array<int>")
    got = sorted(((r["doc_id"] if r["doc_id"] is not None else -1, r["ids"]) for r in T.encode(df).collect()), key=repr)
    want = sorted(((i if i is not None else -1, library([t or ""])[0]) for i, t, _ in rows), key=repr)
    assert got == want
    counts = {r["doc_id"]: r["n_tokens"] for r in T.token_counts(df).collect()}
    assert counts[90] == 0 and counts[0] == 0 and counts[3] == len(library([HARD[3]])[0])
    assert T.encode(df.filter("false")).count() == 0


def test_one_pass_without_shuffle(spark):
    df = spark.createDataFrame([(1, "x", "y")], "doc_id long, text string, other string")
    plan = T.encode(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
