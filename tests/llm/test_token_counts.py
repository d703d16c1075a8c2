"""Token counts against the tokenizers library."""

import random

import pyarrow.parquet as pq
from tokenizers import Tokenizer

from oremill.llm import token_counts
from tests.llm.confusing import PAIR

ODD = [
    None, "", " ", "a", "aaaaaaaaa", "don't we're I'll 'S !'s ''t", "x<|endoftext|>y <|startoftext|><|ENDOFTEXT|>", "Ünïcode ÀÉÎ œŒ ß ÿ Ÿ × ÷ ª º",
    "é é ́x a b  c 　 d\u0085e", "İstanbul ΣΑΣ ΟΔΟΣ ς ǅ", "日本語 テスト １２３ ½ ² ٣", "12345 3.14 1,000", "emoji 👩‍👩‍👧 👍🏽!", "tab\tnew\nline\x0bvt\x0cff\rcr\x1cfs\x00nul",
    "x" * 3000, "ab" * 2000 + " " + "é" * 999, "…“quoted”—dash's", "Å ﬁ ẞ", "a_b-c+d (e) [f] {g}|h~", "Å̊ Å", "<|endoftext|", "﻿bom",
]


def library(texts):
    tok = Tokenizer.from_file(token_counts.vocabulary_path())
    return [len(e.ids) for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def check(spark, texts):
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string, n_bytes string")
    got = sorted(token_counts.token_counts(df).collect())
    want = library(texts)
    wrong = [(t, r.n_tokens, w) for t, r, w in zip(texts, got, want) if r.n_tokens != w]
    assert not wrong, wrong[:5]
    assert [r.n_bytes for r in got] == [len((t or "").encode()) for t in texts]
    assert [r.over_limit for r in got] == [w > 2048 for w in want]


def test_odd_texts(spark):
    check(spark, ODD)


def test_random_mixtures(spark):
    rng = random.Random(5)
    alphabet = list("abcdeABCDE'.,!?<|>0123 \t\n") + ["é", "À", "ß", "ç", "ü", "Ö", "œ", "́", "日", "'s", "'t", "<|endoftext|>", "—", " "]
    check(spark, ["".join(rng.choices(alphabet, k=rng.randint(1, 200))) for _ in range(500)])


def test_documents(spark):
    check(spark, pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist())


def test_empty(spark):
    assert token_counts.token_counts(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_words_that_simple_sums_confuse(spark):
    check(spark, [*PAIR, " ".join(PAIR), PAIR[0]])


def test_repeated_and_null_rows(spark):
    df = spark.createDataFrame([(1, "two words"), (1, "two words"), (None, "x"), (None, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts.token_counts(df).collect()), key=str)
    assert got == [(1, 9, library(["two words"])[0])] * 2 + [(None, 0, 0), (None, 1, 1)]
