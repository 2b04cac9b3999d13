import random

import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from eddyline.llm import token_counts
from tests.llm import helpers as H

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(PATH)


def _counts(whole, texts):
    return [len(e) for e in whole.encode_batch(texts, add_special_tokens=False)]


def test_documents(spark, whole):
    texts = duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{H.SMALL}/documents.parquet' ORDER BY 1").fetchall()
    got = token_counts.op8_token_counts(spark, H.SMALL).orderBy("doc_id").collect()
    want = _counts(whole, [t for _, t in texts])
    assert [tuple(r) for r in got] == [(d, len(t.encode()), n, n > 512) for (d, t), n in zip(texts, want, strict=True)]


def test_cuts_are_safe(whole):
    """Random texts of blanks of every kind, special strings, accents, digits and symbols."""
    r = random.Random(6)
    parts = [" ", " ", "  ", "\n", "\t", "\r\n", " ", " ", "　", "\x1c", "\x85", "a", "Hello", "'s", " 's", "12", "3", "é", "漢字", "😀", "...", "<|endoftext|>", "<|", "ﬁ", "́", "_"]
    texts = ["".join(r.choices(parts, k=r.randint(0, 40))) for _ in range(4000)]
    with open(PATH, "rb") as f:
        counter = token_counts.Counter(f.read())
    assert counter.counts(texts) == _counts(whole, texts)
    assert counter.counts(texts[::-1]) == _counts(whole, texts)[::-1]


def test_memo_is_bounded(whole, monkeypatch):
    monkeypatch.setattr(token_counts, "MEMO_ENTRIES", 10)
    with open(PATH, "rb") as f:
        counter = token_counts.Counter(f.read())
    texts = [f"word{i} {'long' * 40}{i} tail{i}" for i in range(200)]
    for k in range(0, 200, 8):
        assert counter.counts(texts[k : k + 8]) == _counts(whole, texts[k : k + 8])
    assert all(len(p) <= token_counts.MEMO_LENGTH for p in (*counter.first, *counter.later))


def test_long_texts_without_spaces(whole, monkeypatch):
    """Cut at other safe places; encoded in one piece where there is none. Counts are the library's."""
    monkeypatch.setattr(token_counts, "LONG", 40)
    monkeypatch.setattr(token_counts, "PIECE", 7)
    with open(PATH, "rb") as f:
        counter = token_counts.Counter(f.read())
    r = random.Random(4)
    parts = ["漢字", "かな", "。", "，", "！", "abc", "12", "9", "Z", "\n", "\r\n", "\t", "\n\n", "'s", "'", "<|endoftext|>", "é", "١", "ⅷ", "²", "_", "...", "　", "\x85", "ー", " ", "  "]
    texts = ["".join(r.choices(parts, weights=[3] * 25 + [1, 1], k=r.randint(30, 90))) for _ in range(3000)] + ["x" * 5000, "ab1" * 3000, "漢字。" * 2000]
    assert counter.counts(texts) == _counts(whole, texts)
    assert max(map(len, token_counts.further("ab1" * 3000))) < 12 and token_counts.further("x" * 5000) == ["x" * 5000]


def test_other_tokenizers_get_whole_texts(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["a b  c\n d", "Hello wor ld<|endoftext|>x", " lead", "", "x" * 20_000 + " 12ab。"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = [r["n_tokens"] for r in token_counts.count_tokens(docs, path).orderBy("doc_id").collect()]
    assert got == _counts(Tokenizer.from_file(path), texts)
    with open(path, "rb") as f:
        assert not token_counts.Counter(f.read()).may_cut


def test_odd_rows(spark, whole):
    docs = H.odd(spark, n_bytes="x", n_tokens=1, __text="z")
    got = token_counts.count_tokens(docs, PATH)
    assert got.columns == [*H.odd(spark, __text="z").columns, "n_bytes", "n_tokens"]
    texts = [r["text"] or "" for r in got.collect()]
    assert [r["n_tokens"] for r in got.collect()] == _counts(whole, texts)
    assert token_counts.count_tokens(H.empty(spark), PATH).count() == 0
