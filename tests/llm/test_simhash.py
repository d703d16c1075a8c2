"""SimHash near-duplicates against brute force."""

import numpy as np
import xxhash

from oremill.llm import simhash
from oremill.llm.common import Scratch

WS = " \t\n\r\x0b\x0c"


def brute_fp(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))
    words = [w for w in low.encode().split()]
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(ids, fps):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(find(i), []).append(ids[i])
    least = {r: min((x for x in g if x is not None), default=None) for r, g in groups.items()}
    return [least[find(i)] for i in range(len(ids))]


def check(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string, fp string, component_id int")
    got = simhash.near_duplicates(df, Scratch(spark, "t")).collect()
    ids, texts = [d[0] for d in docs], [d[1] for d in docs]
    fps = [brute_fp(t) for t in texts]
    key = lambda r: (str(r[0]), r[1], str(r[2]))
    want = list(zip(ids, fps, brute_components(ids, fps)))
    assert sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got), key=key) == sorted(want, key=key)


def test_edge_cases(spark):
    long = " ".join(f"w{i * i % 977}" for i in range(30000))
    docs = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one two"), (6, "ONE  two\nthree"), (7, "one two three"), (7, "one two three"), (None, "a b c d"), (9, long), (10, long + " tail"), (11, "é À b c")]
    check(spark, [(i, t, "x", 0) for i, t in docs])


def test_random_edits(spark):
    rng = np.random.default_rng(1)
    vocab = [f"v{i}" for i in range(400)]
    docs = []
    for i in range(40):
        words = rng.choice(vocab, 120).tolist()
        for j in range(5):
            docs.append((len(docs), " ".join(words), "x", 0))
            words[int(rng.integers(len(words)))] = "edit"
    check(spark, docs)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(df, Scratch(spark, "t")).collect() == []


def test_tiles_find_every_close_pair(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    fps = set(base.tolist())
    for x in base[:30].tolist():
        for _ in range(6):
            y = x
            for b in rng.choice(64, int(rng.integers(1, 6)), replace=False).tolist():
                y ^= 1 << b
            fps.add(y)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    from oremill.llm.components import components

    scratch = Scratch(spark, "t")
    for tile in (4096, 2):
        edges = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"), scratch, tile=tile)
        got = {r.node: r.root for r in components(edges, scratch).collect()}
        want = brute_components(signed, fps)
        assert [got.get(s, s) for s in signed] == want
