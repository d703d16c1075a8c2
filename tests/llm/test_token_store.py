"""The token store against the tokenizers library: ids, positions, digests and tampering."""

import zlib

import numpy as np
import pyarrow.parquet as pq
from tokenizers import Tokenizer

from oremill.llm import token_store
from oremill.llm.common import Scratch
from tests.llm.confusing import PAIR
from tests.llm.test_token_counts import ODD


def want(rows):
    tok, start, out = Tokenizer.from_file(token_store.vocabulary_path()), 0, []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def check(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, payload string")
    got = [tuple(r) for r in token_store.store_and_read(df, Scratch(spark, "t")).collect()]
    assert all(r[-1] for r in got)
    assert sorted((r[:-1] for r in got), key=lambda r: r[1]) == want(rows)


def test_odd_texts(spark):
    check(spark, [*enumerate(ODD), (None, "no id"), (-5, "word " * 9000), (10_000, "word " * 9000)])


def test_documents(spark):
    t = pq.read_table("/root/testdata/sf0.001/documents.parquet")
    check(spark, list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist())))


def test_repeated_rows_and_empty(spark):
    rows = [(1, "same text"), (1, "same text"), (1, "other")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in token_store.store_and_read(df, Scratch(spark, "t")).collect())
    assert len(got) == 3 and sum(r[2] for r in got) == sum(r[2] for r in want(rows)) and {r[3] for r in got} == {r[3] for r in want(rows)}
    assert token_store.store_and_read(df.limit(0), Scratch(spark, "t")).collect() == []


def test_chunks_are_stored_once_and_tampering_shows(spark):
    text = " ".join(f"word{i % 700}" for i in range(5000))
    df = spark.createDataFrame([(i, text + f" {i}") for i in range(20)], "doc_id long, text string")
    scratch = Scratch(spark, "t")
    token_store.write_store(df, scratch)
    store = spark.read.parquet(f"{scratch.root}/store")
    stored = store.filter("kind = 'chunk'").agg({"n": "sum"}).first()[0]
    assert stored < sum(w[2] for w in want([(i, text + f" {i}") for i in range(20)])) / 5
    broken = [r.asDict() for r in store.filter("kind = 'chunk'").collect()]
    broken[0]["payload"] = bytes(len(broken[0]["payload"]))
    other = Scratch(spark, "t")
    spark.createDataFrame([tuple(r.values()) for r in broken], store.schema).unionByName(store.filter("kind = 'recipe'")).write.partitionBy("kind").parquet(f"{other.root}/store")
    for name in ("index", "manifest"):
        spark.read.parquet(f"{scratch.root}/{name}").write.parquet(f"{other.root}/{name}")
    assert not all(r.verified for r in token_store.read_store(other).collect())


def test_crc_shift():
    a, b = b"abc" * 7, b"xyz12" * 11
    left = token_store.crc_shift(np.array([zlib.crc32(a)]), np.array([len(b)]))[0]
    assert int(left) ^ zlib.crc32(b) == zlib.crc32(a + b)


def test_words_that_simple_sums_confuse_keep_their_ids(spark):
    """Two words of 1,024 letters that collide under every polynomial hash with an odd base."""
    check(spark, [(1, PAIR[0]), (2, PAIR[1]), (3, PAIR[0] + " " + PAIR[1])])


def test_ids_are_put_together_again(spark):
    texts = [*ODD, " ".join(f"word{i % 700}" for i in range(5000))]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id"), (-(1 << 63), "least id")]
    scratch = Scratch(spark, "t")
    token_store.write_store(spark.createDataFrame(rows, "doc_id long, text string"), scratch)
    got = {r.doc_id: (r.start, list(r.ids)) for r in token_store.read_ids(scratch).collect()}
    tok = Tokenizer.from_file(token_store.vocabulary_path())
    start = {w[0]: w[1] for w in want(rows)}
    assert got == {d: (start[d], [*tok.encode(t or "", add_special_tokens=False).ids, 1]) for d, t in rows}
