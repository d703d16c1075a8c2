"""The pipeline's stages, each on its own input, against plain versions."""

import re
from collections import Counter

import corpus_pipeline as p
from oremill.llm.common import load
from tests.llm.test_simhash import brute_components, brute_fp

SF = "/root/testdata/sf0.001"


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages(spark, tmp_path):
    docs = load(spark, SF, "documents").selectExpr("*", "doc_id AS score")
    kept = {}
    for name, stage in p.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        kept[name] = (docs, spark.read.parquet(str(tmp_path / name)))
        docs = kept[name][1]
    for name, (before, after) in kept.items():
        if name != "token_store":
            assert after.columns == list(p.COLUMNS)

    before, after = map(texts, kept["simhash_near_dedup"])
    ids = sorted(before)
    comp = brute_components(ids, [brute_fp(before[i]) for i in ids])
    assert set(after) == set(comp)

    before, after = map(texts, kept["decontamination"])
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    low = lambda t: word.findall("".join(c.lower() if c.isascii() else c for c in t or ""))
    windows = set()
    for r in load(spark, SF, "benchmark").collect():
        w = low(r.text)
        windows |= {tuple(w[i : i + 13]) for i in range(max(1, len(w) - 12))} - {()}
    dirty = set()
    for i, t in before.items():
        w, hit = low(t), set()
        for n in {len(x) for x in windows}:
            for a in range(len(w) - n + 1):
                if tuple(w[a : a + n]) in windows:
                    hit |= set(range(a, a + n))
        if hit and 20 * len(hit) >= len(w):
            dirty.add(i)
    assert dirty and set(after) == set(before) - dirty

    before, after = kept["mixing"][0].collect(), kept["mixing"][1].collect()
    size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    copies = Counter(r.doc_id for r in after)
    assert set(copies.values()) <= {1, 2}
    total, taken, largest = sum(map(size, before)), sum(map(size, after)), max(map(size, before))
    assert abs(taken - 1.5 * total) <= largest

    tokens = kept["token_store"][1].collect()
    assert Counter(r.doc_id for r in tokens) == copies and all(r.verified for r in tokens)
    at = 0
    for r in sorted(tokens, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens


def test_toxic_stage_removes_what_labels_mark(spark):
    sf = "/root/testdata/sf0.1"
    docs = load(spark, sf, "documents")
    kept = {r.doc_id for r in p.drop_toxic(spark, docs, sf).select("doc_id").collect()}
    labels = {r.doc_id: r.toxic for r in load(spark, sf, "labels").collect()}
    toxic = [d for d in labels if labels[d]]
    assert sum(d in kept for d in toxic) / len(toxic) < 0.15
    assert sum(d not in kept for d in labels if not labels[d]) / len(labels) < 0.02


def test_repeated_and_null_rows(spark):
    rows = [(None, None, None, None, None), (1, "a b c", "en", "s", 5), (1, "a b c", "en", "s", 5), (1, "x y z w v", "en", "s", 9), (2, "", "en", None, 0), (3, "a b c d e f", None, "t", 11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    none, clean = (None, None), "a b c d e f"
    key = lambda r: tuple(map(str, r))
    seen = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=key)
    all_rows = sorted([none, (1, "a b c"), (1, "a b c"), (1, "x y z w v"), (2, ""), (3, clean)], key=key)
    assert seen(p.drop_toxic(spark, docs, SF)) == all_rows
    assert seen(p.drop_contaminated(spark, docs, SF)) == all_rows
    # words alone are alike to no other text; the null and the empty text have one fingerprint
    assert seen(p.drop_near_duplicates(spark, docs, SF)) == sorted([(1, "a b c"), (1, "x y z w v"), (2, ""), (3, clean)], key=key)
    mixed = seen(p.mix_sources(spark, docs, SF))
    size = lambda rows: sum(len((t or "").split()) for _, t in rows)
    assert set(mixed) <= set(all_rows) and abs(size(mixed) - 1.5 * size(all_rows)) <= 6
    tokens = p.write_tokens(spark, docs, SF).collect()
    assert sorted((r.doc_id for r in tokens), key=str) == sorted([None, 1, 1, 1, 2, 3], key=str) and all(r.verified for r in tokens)
    for name, stage in p.STAGES:
        assert stage(spark, docs.limit(0), SF).collect() == []


def test_run_leaves_its_result_and_the_store(spark):
    import os

    from oremill.llm.common import shared_dir

    before = set(os.listdir(f"{shared_dir(spark)}/oremill"))
    assert p.run(spark, SF).count() > 0
    left = {n.rsplit("-", 1)[0]: os.listdir(f"{shared_dir(spark)}/oremill/{n}") for n in set(os.listdir(f"{shared_dir(spark)}/oremill")) - before}
    assert {n for n, tables in left.items() if tables} == {"pipeline", "stage_tokens"}


def test_one_row_a_component_where_ids_repeat_or_are_null(spark):
    far = {k: " ".join(f"{k}{i}" for i in range(40)) for k in "abcde"}
    rows = [
        (None, far["a"], "en", "s", 1), (None, far["b"], "en", "s", 2), (None, far["b"], "en", "s", 2),  # unrelated texts without an id; a copy
        (1, far["c"], "en", "s", 3), (1, far["d"], "en", "s", 4),  # one id, two texts
        (2, far["c"], "en", "s", 5), (3, far["e"], "en", "s", 6), (3, far["c"], "en", "s", 7),  # a copy of 1 under an id whose other row stays
        (4, far["e"], "en", None, 8), (4, far["e"], None, "en", 8),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = p.drop_near_duplicates(spark, docs, SF).collect()
    want = [(None, far["a"]), (None, far["b"]), (1, far["c"]), (1, far["d"]), (3, far["e"])]
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.doc_id, r.text) for r in got), key=key) == sorted(want, key=key)


def test_mixing_rows_that_repeat_over_many_parts(spark):
    one = [(None, "a b", "en", "s", 3)] * 300 + [(5, "c d", "en", "s", 3)] * 200 + [(5, "e f", "en", "s", 3)] * 50
    rows = one + [(i, f"w{i} x y", "en", "t", 6) for i in range(10, 210)] + [(None, None, None, None, None)] * 4
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(7)
    got = Counter((r.doc_id, r.text) for r in p.mix_sources(spark, docs, SF).collect())
    have = Counter((r[0], r[1]) for r in rows)
    assert all(n <= 2 * have[k] for k, n in got.items())
    total = sum(len((t or "").split()) * n for (_, t), n in have.items())
    assert abs(sum(len((t or "").split()) * n for (_, t), n in got.items()) - 1.5 * total) <= 3
    assert got == Counter((r.doc_id, r.text) for r in p.mix_sources(spark, docs.repartition(3), SF).collect())
