"""Substring de-duplication by level-wise doubling.

A window of `window` words goes if its words also start earlier (smaller doc_id, or earlier in the document).  Levels
are window / 4, window / 2 and window words.  At each level a window still in question is represented by one stretch
of that level's length inside it, the one with the least hash (at the last level, itself); only windows whose
representative occurs more than once are extended to twice the length, until none is left or the last level decides.
A window that repeats has the same representative wherever it stands, so nothing that repeats is lost, and neighbouring
windows share representatives, so few are sent.

Texts are clustered once into chunks by a hash of doc_id and text, so that no doc_id, null or other, holds a chunk to
itself.  A chunk sends each owner (by leading hash bits) its distinct
representatives once and gets a bitmap back; that is also a map-side combination, so a passage that a third of all
documents share costs one entry a chunk.  Bitmaps are small; texts are not shuffled again after the clustering.  Earlier
levels only choose what is extended.  At the last level, which decides, windows are told apart by 128 bits from two
independent hashes of every word, inside a chunk as between chunks, and entries carry the document in which the chunk
has the window first; the owner marks all but the first document's.

Defined results: null texts have no words and nothing is removed from texts below `window` words; a null doc_id ranks
with the smallest number; rows that repeat a doc_id are ordered by a hash of their text; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_WORD, Scratch, covered, flatten, gram_hashes, load, mix, narrowed, positions_in_rows, ragged_arange, text_bytes, word_bounds, word_hashes

WINDOW = 20
CHUNK_BYTES = 5 << 20
NO_ID = -(1 << 63)
SENT = "owner long, chunk long, hashes binary, extra binary, docs binary, which binary"
ANSWER = "chunk long, level int, owner long, bitmap binary"


def level_lengths(window: int) -> list[int]:
    return sorted({max(1, window // 4), max(1, window // 2), window})


def window_argmin(values: np.ndarray, k: int) -> np.ndarray:
    """For each stretch of k values the position of its first least one, by doubling."""
    at, width = np.arange(len(values)), 1
    while width < k:
        step = min(width, k - width)
        a, b = at[: len(at) - step], at[step:]
        at = np.where(values[b] < values[a], b, a)
        width += step
    return at


def owner_of(hashes: np.ndarray, owners: int) -> np.ndarray:
    """Where each owner's share of sorted hashes begins and ends."""
    lead = (hashes >> np.uint64(32)) * np.uint64(owners) >> np.uint64(32)
    return np.searchsorted(lead, np.arange(owners + 1, dtype=np.uint64))


class Chunk:
    """The words of a chunk's documents in order, and the windows that are still in question."""

    def __init__(self, table: pa.Table, window: int):
        ids = pc.fill_null(table["doc_id"], NO_ID).to_numpy()
        tie = table["tie"].to_numpy()
        order = np.lexsort((tie, ids))
        self.ids, self.tie = ids[order], tie[order]
        self.doc_id = table["doc_id"].take(pa.array(order))
        self.buf, offsets = flatten(table["text"].take(pa.array(order)))
        self.starts, self.ends, self.bounds = word_bounds(self.buf, offsets, SPACE_WORD)
        self.words = word_hashes(self.buf, self.starts, self.ends)
        self.window = window
        self.alive = np.flatnonzero(positions_in_rows(self.bounds, window))

    def representatives(self, length: int):
        """Of the live windows: each one's index into the anchors; the anchors' positions; distinct hashes and, at the last level, second hashes; each anchor's index into those; counts and first positions."""
        grams = gram_hashes(self.words, length)
        if length < self.window and len(self.alive):
            place = window_argmin(grams, self.window - length + 1)[self.alive]
            anchors, of = np.unique(place, return_inverse=True)
        else:
            anchors, of = self.alive, np.arange(len(self.alive))
        # least hashes crowd near 0: mixed again, they spread evenly over the owners
        mixed = mix(grams[anchors])
        if length < self.window:
            values, first, back, count = np.unique(mixed, return_index=True, return_inverse=True, return_counts=True)
            return of, anchors, values, None, back, count, anchors[first]
        second = gram_hashes(word_hashes(self.buf, self.starts, self.ends, 1), length)[anchors] if len(anchors) else mixed
        order = np.lexsort((second, mixed))  # stable: the first of equals stays the first
        new = np.ones(len(order), bool)
        new[1:] = (mixed[order][1:] != mixed[order][:-1]) | (second[order][1:] != second[order][:-1])
        head, back = order[new], np.empty(len(order), np.int64)
        back[order] = np.cumsum(new) - 1
        return of, anchors, mixed[head], second[head], back, np.bincount(back, minlength=len(head)), anchors[head]


def _bits(answers: list[tuple[int, bytes]], cuts: np.ndarray, n: int) -> np.ndarray:
    found = np.zeros(n, bool)
    for owner, bitmap in answers:
        size = cuts[owner + 1] - cuts[owner]
        found[cuts[owner] : cuts[owner + 1]] = np.unpackbits(np.frombuffer(bitmap, np.uint8))[:size]
    return found


def _replay(texts: pa.Table, answers: pa.Table | None, window: int, owners: int, levels: list[int]) -> Chunk:
    """The chunk after the given levels have been answered."""
    chunk = Chunk(texts, window)
    held: dict[int, list] = {}
    if answers is not None:
        for level, owner, bitmap in zip(*[answers[c].to_pylist() for c in ("level", "owner", "bitmap")]):
            held.setdefault(level, []).append((owner, bitmap))
    for length in levels:
        of, anchors, values, _, back, count, first = chunk.representatives(length)
        elsewhere = _bits(held.get(length, []), owner_of(values, owners), len(values))
        if length < window:
            chunk.alive = chunk.alive[(elsewhere | (count > 1))[back][of]]
        else:
            chunk.alive = chunk.alive[(elsewhere[back] | (anchors != first[back]))[of]]
    return chunk


def _send(window: int, owners: int, done: list[int], length: int):
    def run(texts: pa.Table, answers: pa.Table | None = None) -> pa.Table:
        chunk = _replay(texts, answers, window, owners, done)
        _, _, values, other, _, _, first = chunk.representatives(length)
        cuts = owner_of(values, owners)
        full = np.flatnonzero(np.diff(cuts))
        name = texts["chunk"][0].as_py()
        out = {c: [] for c in ("hashes", "extra", "docs", "which")}
        last = length == window
        if last:
            row = np.searchsorted(chunk.bounds, first, side="right") - 1
        for a, b in zip(cuts[full], cuts[full + 1]):
            out["hashes"].append(values[a:b].tobytes())
            rows, which = np.unique(row[a:b], return_inverse=True) if last else (None, None)
            out["extra"].append(other[a:b].tobytes() if last else None)
            out["docs"].append(np.stack([chunk.ids[rows], chunk.tie[rows]], 1).tobytes() if last else None)
            out["which"].append(which.astype(np.uint16 if len(rows) <= 65536 else np.uint32).tobytes() if last else None)
        return pa.table({"owner": pa.array(full, pa.int64()), "chunk": pa.array([name] * len(full), pa.int64()), **{c: pa.array(v, pa.binary()) for c, v in out.items()}})

    return run


def _first(send):
    return lambda texts: send(texts)


def _answer(length: int, last: bool):
    def run(table: pa.Table) -> pa.Table:
        rows = table.select(["hashes", "extra", "docs", "which"]).to_pylist()
        values = [np.frombuffer(r["hashes"], np.uint64) for r in rows]
        cuts = np.cumsum([0] + [len(v) for v in values])
        values = np.concatenate(values)
        if last:
            extra = np.concatenate([np.frombuffer(r["extra"], np.uint64) for r in rows])
            docs = []
            for r, n in zip(rows, np.diff(cuts)):
                ids = np.frombuffer(r["docs"], np.int64).reshape(-1, 2)
                docs.append(ids[np.frombuffer(r["which"], np.uint16 if len(r["which"]) == 2 * n else np.uint32)])
            docs = np.concatenate(docs)
            order = np.lexsort((docs[:, 1], docs[:, 0], extra, values))
            mark = np.zeros(len(order), bool)
            # equal documents are in one chunk, so the first entry of a window is the only one of its document
            mark[order[1:]] = (values[order][1:] == values[order][:-1]) & (extra[order][1:] == extra[order][:-1])
        else:
            _, back, count = np.unique(values, return_inverse=True, return_counts=True)
            mark = count[back] > 1
        return pa.table(
            {
                "chunk": table["chunk"],
                "level": pa.array([length] * len(rows), pa.int32()),
                "owner": table["owner"],
                "bitmap": pa.array([np.packbits(mark[a:b]).tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary()),
            }
        )

    return run


def _keep(window: int, owners: int, levels: list[int]):
    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        chunk = _replay(texts, answers, window, owners, levels)
        gone = covered(chunk.alive, window, len(chunk.starts))
        n = np.diff(chunk.bounds)
        removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[chunk.bounds])
        s, e = chunk.starts[~gone], chunk.ends[~gone]
        size = e - s + 1  # with a space behind each word
        text = chunk.buf[np.minimum(np.repeat(s, size) + ragged_arange(size), max(0, len(chunk.buf) - 1))]
        stops = np.cumsum(size)
        text[stops - 1] = 0x20
        kept_upto = np.concatenate([[0], np.cumsum(~gone)])[chunk.bounds]
        edge = np.concatenate([[0], stops])[kept_upto]
        raw = text.tobytes()
        kept = [raw[a : max(a, b - 1)] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]
        runs = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
        begin, stop = runs[::2], runs[1::2]
        # runs of removed words, cut at rows
        inner = chunk.bounds[1:-1]
        split = inner[(inner > 0) & (inner < len(gone))]
        split = split[gone[split] & gone[split - 1]] if len(split) else split
        begin, stop = np.union1d(begin, split), np.union1d(stop, split)
        row = np.searchsorted(chunk.bounds, begin, side="right") - 1
        cut = np.searchsorted(row, np.arange(len(n) + 1))
        spans = [[[int(x - chunk.bounds[i]), int(y - chunk.bounds[i])] for x, y in zip(begin[cut[i] : cut[i + 1]], stop[cut[i] : cut[i + 1]])] for i in range(len(n))]
        return pa.table(
            {
                "doc_id": chunk.doc_id,
                "n_words": pa.array(n, pa.int64()),
                "n_removed": pa.array(removed, pa.int64()),
                "removed": pa.array(spans, pa.list_(pa.list_(pa.int32()))),
                "kept": pa.array(kept, pa.binary()).cast(pa.string()),
            }
        )

    return run


def substring_dedup(docs: DataFrame, scratch: Scratch, window: int = WINDOW) -> DataFrame:
    """Per document row: doc_id, n_words, n_removed, removed (word spans, end exclusive), kept (text of the other words)."""
    spark = scratch.spark
    texts = narrowed(docs, "doc_id", "text")
    chunks = max(1, -(-text_bytes(texts) // CHUNK_BYTES))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    owners = max(parts, chunks // 4)
    ids, tie = F.col("doc_id").cast("long"), F.xxhash64("text")
    chunk = F.pmod(F.xxhash64(ids, "text"), F.lit(chunks))
    table = scratch.put_bucketed("texts", texts.select(ids.alias("doc_id"), "text", tie.alias("tie"), chunk.alias("chunk")), "chunk", max(parts, chunks // 4))
    levels, answers = level_lengths(window), None
    for k, length in enumerate(levels):
        send = _send(window, owners, levels[:k], length)
        by_chunk = table.groupBy("chunk")
        sent = by_chunk.applyInArrow(_first(send), SENT) if answers is None else by_chunk.cogroup(answers.groupBy("chunk")).applyInArrow(send, SENT)
        now = scratch.put(f"answers{length}", sent.groupBy("owner").applyInArrow(_answer(length, length == window), ANSWER))
        answers = now if answers is None else answers.unionByName(now)
    return table.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_keep(window, owners, levels), "doc_id long, n_words long, n_removed long, removed array<array<int>>, kept string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: every document."""
    with Scratch(spark, "substring_dedup") as scratch:
        found = substring_dedup(load(spark, sf_dir, "documents"), scratch)
        return scratch.finish(found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, p, array_to_string(w[p:p + 19], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM d WHERE len(w) >= 20)),
bad AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY g ORDER BY doc_id, p) AS k FROM win) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS q FROM bad),
words AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS q FROM d),
j AS (SELECT words.doc_id, words.q, words.x, gone.q IS NOT NULL AS g FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.q = gone.q),
a AS (SELECT doc_id, count(*) FILTER (WHERE g) AS n_removed, string_agg(x, ' ' ORDER BY q) FILTER (WHERE NOT g) AS kept FROM j GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN a USING (doc_id)
"""
