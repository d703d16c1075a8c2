"""Benchmark decontamination by a prefix-filtered set join of word shingles.

Every window of 13 item words (an item of fewer words is one window) is a record.  Containment of a whole window is
asked for, so one shingle of each record is a necessary prefix: the rarest of its shingles, by counts over all
documents.  Documents are probed with prefix shingles only; a match is held against the positional bound (the window
may not begin before the document) and the length bound (nor end after it) and verified word by word, by the bytes.

Items longer than PIECE words are cut to pieces that share window - 1 words, and pieces are taken in blocks of about
BLOCK_BYTES of text; each block is one pass of counting and one of probing.  What is sent to executors for a block, its
text and six numbers a window, is bounded whatever the number and length of the items.

Defined results: null texts have no words; items without words are ignored; equal item_ids count once and a null
item_id is written `null`; documents without words are never contaminated; repeated rows are judged each; empty
tables on either side and extra columns do no harm.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM_WORD, LOWER, Scratch, byte_rows, find_sorted, flatten, gram_hashes, lanes_of, load, narrowed, positions_in_rows, ragged_arange, same_words, text_bytes, word_bounds, word_hashes

WINDOW = 13
SHINGLE = 3
BLOCK_BYTES = 4 << 20
PIECE = 2048
SLICE_BYTES = 4 << 20
_FILTER_BITS = 20


def words_of(col) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased bytes, each word's hash, begin and end, and the rows' offsets among the words."""
    buf, offsets = flatten(col)
    buf = LOWER[buf]
    starts, ends, bounds = word_bounds(buf, offsets, ALNUM_WORD)
    return buf, word_hashes(buf, starts, ends), starts, ends, bounds


def _pieces(piece: int, window: int):
    """Items cut to at most `piece` words, the last window - 1 of which begin the next one as well."""

    def run(batches):
        for batch in byte_rows(SLICE_BYTES, batches):
            buf, _, starts, ends, bounds = words_of(batch.column(1))
            n = np.diff(bounds)
            count = np.where(n > piece, -(-(n - window + 1) // (piece - window + 1)), (n > 0).astype(np.int64))
            row = np.repeat(np.arange(len(n)), count)
            first = bounds[:-1][row] + ragged_arange(count) * (piece - window + 1)
            last = np.minimum(first + piece, bounds[1:][row]) - 1
            texts = [buf[a:b].tobytes() for a, b in zip(starts[first].tolist(), ends[last].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(texts, pa.binary()).cast(pa.string())], names=["item_id", "text"])

    return run


class Probe:
    """Sorted keys behind a small bit table that most positions do not pass."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = np.zeros(1 << _FILTER_BITS, bool)
        self.bits[(keys >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True

    def find(self, grams: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions whose gram is a key, and which."""
        at = np.flatnonzero(self.bits[(grams >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] & valid)
        key = find_sorted(self.keys, grams[at])
        return at[key >= 0], key[key >= 0]


class Index:
    """The windows of a block of items: distinct by their words, with their shingles."""

    def __init__(self, ids: list[str], texts: pa.Array, window: int, shingle: int):
        self.buf, h0, self.starts, self.ends, bounds = words_of(texts)
        self.ids = ids
        n = np.diff(bounds)
        windows = np.where(n >= window, n - window + 1, (n > 0).astype(np.int64))
        self.item = np.repeat(np.arange(len(n)), windows)
        self.start = np.repeat(bounds[:-1], windows) + ragged_arange(windows)
        self.length = np.minimum(n, window)[self.item]
        self.k = np.minimum(self.length, shingle)
        count = self.length - self.k + 1
        self.of = np.repeat(np.arange(len(self.item)), count)
        self.offset = ragged_arange(count)
        at, k = self.start[self.of] + self.offset, self.k[self.of]
        grams = np.zeros(len(at), np.uint64)
        for size in range(1, shingle + 1):
            if (k == size).any():
                grams[k == size] = gram_hashes(h0, size)[at[k == size]]
        self.grams, self.sizes = grams, k

    def for_probe(self) -> "Index":
        """Without the shingles: what probing needs besides the prefixes."""
        lean = object.__new__(Index)
        lean.ids, lean.buf, lean.starts, lean.ends = self.ids, self.buf, self.starts, self.ends
        lean.item, lean.start, lean.length = self.item, self.start, self.length
        return lean

    def keys(self, size: int) -> np.ndarray:
        return np.unique(self.grams[self.sizes == size])

    def prefixes(self, counts: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """By shingle size: sorted prefix keys, offsets into the records that have each, and those records' windows and offsets."""
        seen = np.zeros(len(self.grams), np.int64)
        for size, c in counts.items():
            mine = self.sizes == size
            seen[mine] = c[np.searchsorted(self.keys(size), self.grams[mine])]
        order = np.lexsort((self.offset, seen, self.of))
        rarest = order[np.flatnonzero(np.diff(self.of[order], prepend=-1))]
        found = {}
        for size in counts:
            mine = rarest[self.sizes[rarest] == size]
            mine = mine[np.argsort(self.grams[mine], kind="stable")]
            keys, first = np.unique(self.grams[mine], return_index=True)
            found[size] = (keys, np.append(first, len(mine)), self.of[mine], self.offset[mine])
        return found


def _count(keys: dict[int, np.ndarray]):
    def run(batches):
        probes = {size: Probe(k) for size, k in keys.items()}
        sums = {size: np.zeros(len(k), np.int64) for size, k in keys.items()}
        for batch in byte_rows(SLICE_BYTES, batches):
            _, h0, _, _, bounds = words_of(batch.column(0))
            for size, probe in probes.items():
                _, key = probe.find(gram_hashes(h0, size), positions_in_rows(bounds, size))
                sums[size] += np.bincount(key, minlength=len(sums[size]))
        for size, c in sums.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([size] * len(at), pa.int32()), pa.array(at, pa.int64()), pa.array(c[at], pa.int64())], names=["size", "key", "n"])

    return run


def _probe(index: Index, prefixes: dict):
    def run(batches):
        probes = {size: Probe(p[0]) for size, p in prefixes.items()}
        ids, item_lanes = np.array(index.ids, dtype=object), lanes_of(index.buf)
        for batch in byte_rows(SLICE_BYTES, batches):
            names = batch.schema.names
            buf, h0, starts, ends, bounds = words_of(batch.column(names.index("text")))
            lanes, total = lanes_of(buf), len(h0)
            begin, window = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            row_of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            for size, (_, first, of, offset) in prefixes.items():
                at, key = probes[size].find(gram_hashes(h0, size), positions_in_rows(bounds, size))
                each = (first[1:] - first[:-1])[key]
                rec = np.repeat(first[:-1][key], each) + ragged_arange(each)
                at, rec = np.repeat(at, each), rec
                start, w = at - offset[rec], of[rec]
                row = row_of[at]
                keep = (start >= bounds[row]) & (start + index.length[w] <= bounds[row + 1])
                start, w = start[keep], w[keep]
                for j in range(int(index.length[w].max()) if len(w) else 0):
                    if not len(w):
                        break
                    inside = np.flatnonzero(j < index.length[w])
                    a, b = start[inside] + j, index.start[w[inside]] + j
                    same = np.ones(len(w), bool)
                    same[inside] = same_words(buf, starts[a], ends[a], index.buf, index.starts[b], index.ends[b], lanes, item_lanes)
                    start, w = start[same], w[same]
                begin.append(start)
                window.append(w)
            start, w = np.concatenate(begin), np.concatenate(window)
            change = np.zeros(total + 1, np.int64)
            np.add.at(change, start, 1)
            np.add.at(change, start + index.length[w], -1)
            hit = np.cumsum(change[:-1]) > 0
            held = batch.column(names.index("hit")).to_pylist()
            for i, bits in enumerate(held):  # of earlier blocks
                if bits:
                    hit[bounds[i] : bounds[i + 1]] |= np.unpackbits(np.frombuffer(bits, np.uint8))[: bounds[i + 1] - bounds[i]].astype(bool)
            n_hit = np.diff(np.concatenate([[0], np.cumsum(hit)])[bounds])
            pairs = np.unique(row_of[start] * np.int64(len(ids) or 1) + index.item[w]) if len(start) else np.zeros(0, np.int64)
            prow, pitem = pairs // (len(ids) or 1), pairs % (len(ids) or 1)
            cuts = np.searchsorted(prow, np.arange(len(bounds)))
            items = [sorted({*old, *ids[pitem[cuts[i] : cuts[i + 1]]].tolist()}) for i, old in enumerate(batch.column(names.index("items")).to_pylist())]
            bits = [np.packbits(hit[bounds[i] : bounds[i + 1]]).tobytes() if n_hit[i] else None for i in range(len(items))]
            new = {"n_words": pa.array(np.diff(bounds), pa.int64()), "n_hit": pa.array(n_hit, pa.int64()), "hit": pa.array(bits, pa.binary()), "items": pa.array(items, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays([new.get(c, batch.column(i)) for i, c in enumerate(names)], names=names)

    return run


def decontaminate(docs: DataFrame, items: DataFrame, scratch: Scratch, window: int = WINDOW, shingle: int = SHINGLE, keep_text: bool = False) -> DataFrame:
    """Per document row: doc_id, n_words, n_hit, hit (bit mask over its words, null: none), items, contaminated.

    With keep_text the documents' own columns stay, but for those of a name given here.
    """
    items = narrowed(items, "item_id", "text").select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), "text")
    pieces = scratch.put("pieces", items.mapInArrow(_pieces(max(PIECE, 2 * window), window), "item_id string, text string").withColumn("piece", F.xxhash64("item_id", "text")))
    blocks = max(1, -(-text_bytes(pieces) // BLOCK_BYTES))
    empty = [F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.lit(None).cast("binary").alias("hit"), F.array().cast("array<string>").alias("items")]
    own = [c for c in docs.columns if c not in ("n_words", "n_hit", "hit", "items", "contaminated")]
    held = docs.select(*([F.col(f"`{c}`") for c in own] if keep_text else [F.col("doc_id"), F.col("text")]), *empty)
    for b in range(blocks):
        block = pieces.filter(F.pmod("piece", F.lit(blocks)) == b).select("item_id", "text").distinct().collect()  # about BLOCK_BYTES of text
        index = Index([r["item_id"] for r in block], pa.array([r["text"] for r in block], pa.large_string()), window, shingle)
        sizes = {int(s): index.keys(int(s)) for s in np.unique(index.sizes)}
        counts = {s: np.zeros(len(k), np.int64) for s, k in sizes.items()}
        summed = narrowed(docs, "text").mapInArrow(_count(sizes), "size int, key long, n long").groupBy("size", "key").agg(F.sum("n").alias("n"))
        for r in summed.toLocalIterator():  # at most one row for each shingle of the block
            counts[r["size"]][r["key"]] = r["n"]
        held = held.mapInArrow(_probe(index.for_probe(), index.prefixes(counts)), held.schema)
        if blocks > 1:
            held = scratch.put(f"block{b}", held)
            scratch.drop(f"block{b - 1}")
    scratch.drop("pieces")
    return held.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: every document against every benchmark item."""
    found = decontaminate(narrowed(load(spark, sf_dir, "documents"), "doc_id", "text"), load(spark, sf_dir, "benchmark"), Scratch(spark, "decontaminate"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )


ORACLE = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 13) AS l, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, least(len(w), 1)) + 1)) AS i FROM bw)),
ls AS (SELECT DISTINCT l FROM win),
dg AS (SELECT doc_id, p, l, array_to_string(w[p:p + l - 1], ' ') AS g FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS p FROM dw, ls WHERE len(w) >= l)),
occ AS (SELECT dg.doc_id, dg.p, dg.l, win.item_id FROM dg JOIN win ON dg.g = win.g AND dg.l = win.l),
hits AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(p, p + l)) AS q FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS s FROM (SELECT DISTINCT doc_id, coalesce(CAST(item_id AS VARCHAR), 'null') AS i FROM occ) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hits USING (doc_id) LEFT JOIN its USING (doc_id)
"""
