"""The Pitman-Yor model: exact counts and base scores, normalisation of its parts, seating invariants and held-out gain."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from oremill.llm import language_model as lm
from oremill.llm.common import Scratch, word_hashes
from tests.llm.confusing import ONE_HASH, PAIR


def tokens(text):
    return ["".join(c.lower() if c.isascii() else c for c in w.decode()) for w in (text or "").encode().split()] + [None]


def held(doc):
    return doc is not None and zlib.crc32(str(doc).encode()) % 7 == 2


def check(spark, rows):
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, owner int")
    got = lm.score_documents(df, Scratch(spark, "t")).collect()
    counts = Counter(t for d, x in rows if not held(d) for t in tokens(x))
    n, v = sum(counts.values()), len(counts)
    want = []
    for d, x in rows:
        t = tokens(x)
        want.append((d, held(d), len(t), sum(counts[w] > 0 for w in t), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t), 6)))
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=key) == sorted(want, key=key)
    assert all(math.isfinite(r.score) and r.score <= 1e-9 for r in got)
    return {r.doc_id: r for r in got}


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "A b C"), (5, "é É x " * 3000), (6, "a b c"), (7, "of " * 500)]
    check(spark, rows)
    only = [d for d in range(100) if held(d)][:2]
    got = check(spark, [(d, "never learned") for d in only])
    assert all(r.score == 0 for r in got.values())
    assert lm.score_documents(spark.createDataFrame([], "doc_id long, text string"), Scratch(spark, "t")).collect() == []


def test_words_that_simple_sums_confuse(spark):
    got = check(spark, [(1, PAIR[0]), (3, PAIR[1]), (4, f"{PAIR[0]} {PAIR[1]} x")])
    assert got[4].n_known == 4


def test_words_that_the_hash_confuses(spark):
    """Words of one hash, dealt to one owner: one of each pair is learned, the other held out."""
    learned, out = [d for d in range(60) if not held(d)][:4], [d for d in range(60) if held(d)][:4]
    rows = [(d, a) for d, (a, _) in zip(learned, ONE_HASH)] + [(d, b) for d, (_, b) in zip(out, ONE_HASH)]
    for a, b in ONE_HASH:
        buf = np.frombuffer((a + b).encode(), np.uint8)
        x, y = word_hashes(buf, np.array([0, len(a)]), np.array([len(a), len(a + b)]))
        assert a != b and x == y
    got = check(spark, rows)
    assert [got[d].n_known for d in out] == [1] * 4
    both = check(spark, [(learned[0], " ".join(a + " " + b for a, b in ONE_HASH)), (out[0], ONE_HASH[2][1] + " other")])
    assert both[out[0]].n_known == 2


def test_counts_beyond_32_bits_are_carried():
    for counts in ([1, (1 << 32) + 5], [1, (1 << 32) - 1], []):
        assert lm.unpack(lm.pack(np.array(counts, np.int64)), len(counts)).tolist() == counts


def test_probabilities_are_averaged_over_sweeps():
    """The mean of the probabilities of single sweeps, each computed by itself, and not that of averaged tables and roots."""
    rng, d, n, sweeps = np.random.default_rng(4), 0.6, 200, 3
    c, tables, more = rng.integers(1, 40, n), rng.integers(1, 30, (sweeps, n)), rng.integers(0, 400, (sweeps, n))
    root, customers = rng.random((sweeps, n)) / 50, rng.integers(400, 900, n)
    each = [[(c[i] - d * tables[k, i] + (lm.STRENGTH + d * more[k, i]) * root[k, i]) / (lm.STRENGTH + customers[i]) for i in range(n)] for k in range(sweeps)]
    got = lm.predictive(c - d * tables.mean(0), more, root, customers, d)
    assert np.abs(got - np.mean(each, 0)).max() < 1e-12


def test_one_document_scored_by_hand(spark, monkeypatch):
    """Every pair once, so every seating is known: one table a pair, and the root's customers are the pairs."""
    doc = next(d for d in range(9) if not held(d))
    got = lm.score_documents(spark.createDataFrame([(doc, "a b c")], "doc_id long, text string"), Scratch(spark, "t")).collect()[0]
    d, types, customers, root_tables = lm.discount_of(4, 0), 4, 4, 4
    for k in range(lm.SWEEPS):  # the root: one customer a word, each at a table of its own
        root_d = 0.5 if k == 0 else lm.discount_of(4, 0)
    root = ((1 - root_d) + (lm.STRENGTH + root_d * root_tables) / (types + 1)) / (lm.STRENGTH + customers)
    p = ((1 - d) + (lm.STRENGTH + d) * root) / (lm.STRENGTH + 1)
    assert abs(got.score - 4 * math.log10(p)) < 1e-6


def test_better_than_base(spark, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK_BYTES", 3000)
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(40)]
    follow = {w: rng.choices(vocab, k=3) for w in vocab}

    def text():
        out = [rng.choice(vocab)]
        while len(out) < 40:
            out.append(rng.choice(follow[out[-1]]) if rng.random() < 0.8 else rng.choice(vocab))
        return " ".join(out)

    rows = [(i, text()) for i in range(300)]
    got = check(spark, rows)
    gain = [r.score - r.base_score for d, r in got.items() if held(d)]
    assert gain and sum(gain) / len(gain) > 3


def test_predictive_sums_to_one():
    """Owner and root arithmetic on a small seating: sum over words of p(w | u) is 1."""
    rng = np.random.default_rng(0)
    counts = {(u, w): int(rng.integers(1, 9)) for u in range(5) for w in range(12) if rng.random() < 0.6}
    pairs = sorted(counts)
    several = sorted((p for p in pairs if counts[p] > 1), key=lambda p: -counts[p])
    c = np.array([counts[p] for p in several])
    per = np.bincount([u for u, _ in pairs], minlength=5)
    seat = lm.Restaurants(c, np.array([u for u, _ in several]), per.copy(), np.zeros(c.sum(), np.int64))
    for _ in range(20):
        seat.sweep(0.6, np.full(len(c), 1 / 13), rng, 100)
        t = seat.tables()
        sizes = [seat.size[a : a + n] for a, n in zip(seat.start, c)]
        assert all(s.sum() == n and (s > 0).sum() == k for s, n, k in zip(sizes, c, t))
        again = np.bincount([u for u, w in pairs if counts[u, w] == 1], minlength=5)
        np.add.at(again, [u for u, _ in several], t)
        assert (again == seat.context_tables).all()
    tables = {p: 1 for p in pairs} | dict(zip(several, t.tolist()))
    customers = np.zeros(12, np.int64)
    for (_, w), k in tables.items():
        customers[w] += k
    rt = lm.seat_root(customers, 0.5, 0.4, rng)
    types = int((customers > 0).sum())
    rest = (1 + 0.4 * rt.sum()) / (types + 1) / (1 + customers.sum())
    root = np.where(customers > 0, (customers - 0.4 * rt) / (1 + customers.sum()) + rest, 0)
    assert abs(root.sum() + rest - 1) < 1e-12
    for u in range(5):
        n = sum(counts[p] for p in pairs if p[0] == u)
        k = sum(tables[p] for p in pairs if p[0] == u)
        p = sum((counts.get((u, w), 0) - 0.6 * tables.get((u, w), 0) + (1 + 0.6 * k) * r) / (1 + n) for w, r in enumerate(root))
        assert abs(p + (1 + 0.6 * k) * rest / (1 + n) - 1) < 1e-12


def test_gibbs_finds_the_posterior():
    """One pair of three customers, alone in its restaurant: the chance of one, two and three tables is known."""
    d, root, rng = 0.5, 0.3, np.random.default_rng(1)
    n = 20000
    seat = lm.Restaurants(np.full(n, 3), np.arange(n), np.ones(n, np.int64), np.zeros(3 * n, np.int64))
    for _ in range(30):
        seat.sweep(d, np.full(n, root), rng, 100)
    got = np.bincount(seat.tables(), minlength=4)[1:] / n
    # weight of a seating: product over new tables after the first of (1 + d k), of root for each table, and of joins (size - d)
    w = np.array([root * (1 - d) * (2 - d), root**2 * (1 + d) * (1 - d) * 3, root**3 * (1 + d) * (1 + 2 * d)])
    assert np.abs(got - w / w.sum()).max() < 0.02


def exact_tables(counts, roots, discount, singles):
    """Mean tables of the pairs of one context that also has `singles` pairs of one customer, by summing over all numbers of tables."""
    weights = []
    for c, root in zip(counts, roots):
        w = np.full(c + 1, -np.inf)
        w[1] = 0.0
        with np.errstate(divide="ignore"):
            for n in range(1, c):
                w[1:] = np.logaddexp(w[:-1], np.log(np.maximum(n - discount * np.arange(1, c + 1), 0)) + w[1:])
        weights.append(w + np.arange(c + 1) * np.log(root))
    total = sum(counts) + singles + 1
    rising = np.concatenate([[0.0], np.cumsum(np.log(lm.STRENGTH + discount * np.arange(total)))])
    means = []
    for i in range(len(counts)):
        rest = np.zeros(1)
        for j in range(len(counts)):
            if j != i:
                rest = np.logaddexp.reduce([np.pad(rest + x, (t, len(weights[j]) - 1 - t), constant_values=-np.inf) for t, x in enumerate(weights[j])])
        logs = np.array([np.logaddexp.reduce(rest + rising[singles + t : singles + t + len(rest)]) for t in range(counts[i] + 1)]) + weights[i]
        p = np.exp(logs - logs.max())
        means.append((p * np.arange(len(p))).sum() / p.sum())
    return means


def test_hot_pairs_are_seated_whole():
    """Tables of pairs far above SCAN customers after a model's usual sweeps, against the exact posterior."""
    d, counts, roots, singles, contexts = 0.75, [2500, 60, 40], [0.2, 0.1, 0.05], 600, 60
    n = len(counts) + singles
    number = np.tile(np.array(counts + [1] * singles, np.uint32), contexts)
    words = np.tile(np.arange(n, dtype=np.uint32), contexts)
    sent = {"owner": [0], "contexts": [np.arange(contexts, dtype=np.uint32)], "sizes": [np.full(contexts, n, np.uint32)], "words": [words], "counts": [number]}
    offsets = np.array([0, n])
    rows = lm._gather(offsets)(pa.table({k: v if k == "owner" else [v[0].tobytes()] for k, v in sent.items()})).to_pylist()
    static = pa.table({k: [r[k] for r in rows if r["kind"] == lm.PAIRS] for k in ("owner", "a", "b")})
    for k in range(lm.SWEEPS):
        seats = next(r for r in rows if r["kind"] == lm.SEATS)
        told = pa.table({"root": [None, 0], "share": [seats["a"], np.array(roots, np.float32).tobytes()], "mean": [seats["b"], None]})
        rows = lm._gibbs(offsets, d, 1.0, 0.0, float(k == lm.SWEEPS - 1), k)(static, told).to_pylist()
    mean, kept = np.split(np.frombuffer(next(r for r in rows if r["kind"] == lm.SEATS)["b"], np.float32), [len(counts) * contexts])
    assert (kept == mean.reshape(len(counts), contexts).sum(0) + singles).all()
    got = mean.reshape(len(counts), contexts).mean(1)
    want = exact_tables(counts, roots, d, singles)
    assert want[0] > 1 + lm.SCAN * lm.SWEEPS
    assert np.abs(got / want - 1).max() < 0.1, (got, want)


def test_numbers_of_tables():
    """Draws on both sides of the table of Stirling numbers against exact weights."""
    rng = np.random.default_rng(2)
    for d, n, weight in [(0.75, 100, 5.0), (0.75, 1500, 20.0), (0.4, 1500, 300.0), (0.9, 1500, 3000.0)]:
        t = np.arange(1, n + 1)
        logs = lm.log_stirling(n, d)[n, 1:] + t * np.log(weight)
        p = np.exp(logs - logs.max())
        mean = (p * t).sum() / p.sum()
        sd = math.sqrt((p * (t - mean) ** 2).sum() / p.sum())
        got = lm.draw_tables(np.full(4000, n), np.full(4000, weight), d, rng)
        assert abs(got.mean() - mean) < 0.08 * sd and abs(got.std() / sd - 1) < 0.06


def test_samples_kept():
    """A score averages three sweeps at least, after one that is not kept."""
    assert lm.BURN >= 1 and lm.SWEEPS - lm.BURN >= 3
