"""Token ids in a content-addressed store.

File format, below one folder (integers little-endian):

* `store/kind=chunk`: digest (SHA-256 of the ids as unsigned 32-bit), n, wide, payload: each distinct chunk once, its ids
  as unsigned 16-bit numbers, or 32-bit where `wide`.
* `store/kind=recipe`: doc_id and the digests and lengths of the document's chunks, in order.
* `index`: recipes range-partitioned and sorted by doc_id, numbered, with the ids before each document in its part and
  the Merkle root of its chunks; `manifest`: each part's first id position and the Merkle root of its documents.

A chunk ends where a rolling hash of the last WINDOW ids has its leading CUT_BITS bits clear, or at MOST ids, so equal
passages give equal chunks wherever they stand.  Reading verifies every chunk's digest, every document's and every
part's root; `read_ids` puts the documents' ids together again from the chunks.

Each distinct pre-token is encoded once a slice by the tokenizers library's model and then looked up by its bytes; words
that the vectorised pre-tokenizer does not cover are encoded whole by the library.  A task sends a chunk that it has
sent before (of the last SENT ones) only as a reference, so that a common chunk reaches its owner about once a task.

Defined results: null text reads as empty, which encodes to the end id alone; a null doc_id is written first; rows that
repeat a doc_id are documents of their own, in a fixed order; an empty table gives an empty store; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, byte_rows, load, mix, narrowed, parts_for, ragged_arange
from .pretokens import Cache, distinct, units
from .token_counts import byte_chars, vocabulary_path

END_ID = 1
WINDOW = 16
CUT_BITS = 8
MOST = 2048
SLICE_BYTES = 2 << 20
JOINED = 64
CACHED = 6
SENT = 1 << 16
_BASE = 0x9E3779B97F4A7C15


# ---------------------------------------------------------------- encoding
class Encoder:
    """Texts to ids, by the library; distinct pre-tokens once a slice, short ones also from a bounded cache."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        self.full = Tokenizer.from_str(json.dumps(held))
        # the same model on pre-tokens as they are: already lower-cased, cut and byte-mapped
        self.plain = Tokenizer.from_str(json.dumps(held | {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "WhitespaceSplit"}}))
        end = held["model"]["end_of_word_suffix"]
        self.ends_word = np.zeros(max(held["model"]["vocab"].values()) + 1, bool)
        self.ends_word[[i for token, i in held["model"]["vocab"].items() if token.endswith(end)]] = True
        self.points = np.array([ord(c) for c in byte_chars()], "<u4")
        self.points[0x20] = 0x20  # a space stands between pre-tokens, never inside one
        self.cache = Cache(CACHED + 1, np.int32)

    def easy(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens, by the model; many go in one call, and ids that end a word tell them apart again."""
        size = ends - starts + 1  # with a space behind each
        stop = np.cumsum(size)
        flat = buf[np.minimum(np.repeat(starts, size) + ragged_arange(size), max(0, len(buf) - 1))]
        flat[stop - 1] = 0x20
        text = self.points[flat].tobytes().decode("utf-32-le")
        edge = [0, *stop[JOINED - 1 :: JOINED].tolist()]
        lines = [text[a : b - 1] for a, b in zip(edge, [*edge[1:], len(text)]) if b > a]
        found = [e.ids for e in self.plain.encode_batch_fast(lines, add_special_tokens=False)]
        ids = np.fromiter(itertools.chain.from_iterable(found), np.int32, sum(map(len, found)))
        return ids, np.diff(np.flatnonzero(self.ends_word[ids]), prepend=-1)

    def hard(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole words, by the full tokenizer."""
        raws = [buf[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(starts.tolist(), ends.tolist())]
        found = [e.ids for e in self.full.encode_batch_fast(raws, add_special_tokens=False)]
        return np.array([i for f in found for i in f], np.int32), np.array([len(f) for f in found], np.int64)

    def encode(self, col) -> tuple[np.ndarray, np.ndarray]:
        """All rows' ids in one array, an END_ID after each row, and the rows' offsets."""
        buf, starts, ends, slow, hashes, bounds = units(col)
        first, which = distinct(buf, starts, ends, hashes)
        begins, stops = starts[first], ends[first]
        slot, keys, known = self.cache.find(buf, begins, stops, hashes[first])
        held = self.cache.values[slot]
        size = held[:, 0].astype(np.int64)
        missed = ~known
        got = []
        for at, encode in ((np.flatnonzero(missed & ~slow[first]), self.easy), (np.flatnonzero(missed & slow[first]), self.hard)):
            ids, size[at] = encode(buf, begins[at], stops[at])
            got.append((at, ids))
        begin = np.cumsum(size) - size
        flat = np.zeros(int(size.sum()), np.int32)
        known = np.flatnonzero(known)
        step = ragged_arange(size[known])
        flat[np.repeat(begin[known], size[known]) + step] = held[np.repeat(known, size[known]), 1 + step]
        for at, ids in got:
            flat[np.repeat(begin[at], size[at]) + ragged_arange(size[at])] = ids
        short = np.flatnonzero(missed & (size <= CACHED) & (stops - begins <= self.cache.KEY_BYTES))
        rows = np.zeros((len(short), CACHED + 1), np.int32)
        rows[:, 0] = size[short]
        step = ragged_arange(size[short])
        rows[np.repeat(np.arange(len(short)), size[short]), 1 + step] = flat[np.repeat(begin[short], size[short]) + step]
        self.cache.put(slot[short], keys[short], rows)
        length = size[which] if len(which) else np.zeros(0, np.int64)
        n = np.diff(np.concatenate([[0], np.cumsum(length)])[bounds])
        offsets = np.concatenate([[0], np.cumsum(n + 1)])
        ids = np.full(int(offsets[-1]), END_ID, np.int32)
        where = np.ones(len(ids), bool)
        where[offsets[1:] - 1] = False
        ids[where] = flat[np.repeat(begin[which], length) + ragged_arange(length)] if len(which) else 0
        return ids, offsets


_held: dict[str, Encoder] = {}


def held_encoder(path: str) -> Encoder:
    """The encoder of this Python worker, which serves its later tasks too."""
    if path not in _held:
        _held.clear()
        _held[path] = Encoder(path)
    return _held[path]


_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def rolled(ids: np.ndarray) -> np.ndarray:
    """A polynomial hash modulo 2^64 of the WINDOW ids from each position on; its leading bits are the good ones."""
    global _powers
    n = len(ids)
    if n < WINDOW:
        return np.zeros(0, np.uint64)
    if len(_powers[0]) < n:
        up, down = np.full(2 * n, _BASE, np.uint64), np.full(2 * n, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    table = mix(np.arange(1, int(ids.max()) + 2, dtype=np.uint64))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(table[ids] * _powers[0][:n], out=total[1:])
    return (total[WINDOW:] - total[:-WINDOW]) * _powers[1][: n - WINDOW + 1]


def cut_points(ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Ends of all chunks: each row's end, content-defined ends, and every MOST ids where there are none."""
    total = len(ids)
    ends = np.zeros(total + 1, bool)
    ends[offsets[1:]] = True
    at = np.flatnonzero(rolled(ids) >> np.uint64(64 - CUT_BITS) == 0) + WINDOW
    row = np.searchsorted(offsets, at, side="left") - 1
    ends[at[at - WINDOW >= offsets[row]]] = True  # the window lies in the row
    cuts = np.flatnonzero(ends)
    cuts = cuts[cuts > 0]
    begin = np.concatenate([[0], cuts[:-1]])
    extra = (cuts - begin - 1) // MOST
    if extra.any():
        more = np.repeat(begin, extra) + MOST * (ragged_arange(extra) + 1)
        cuts = np.union1d(cuts, more)
    return cuts


def merkle(digests: list[bytes]) -> bytes:
    """Root of a binary Merkle tree; an odd last node is carried up; no nodes: SHA-256 of nothing."""
    if not digests:
        return hashlib.sha256(b"").digest()
    level = [hashlib.sha256(b"\x00" + d).digest() for d in digests]
    while len(level) > 1:
        level = [hashlib.sha256(b"\x01" + b"".join(level[i : i + 2])).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


ROW = "kind string, route long, doc_id long, digest binary, n long, wide boolean, payload binary, digests binary, sizes binary"
_FIELDS = [("kind", pa.string()), ("route", pa.int64()), ("doc_id", pa.int64()), ("digest", pa.binary()), ("n", pa.int64()), ("wide", pa.bool_()), ("payload", pa.binary()), ("digests", pa.binary()), ("sizes", pa.binary())]


def _routes(digests) -> np.ndarray:
    return np.frombuffer(b"".join(digests), "<i8").reshape(-1, 4)[:, 0]


def _batch(rows: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([(columns[name] if isinstance(columns[name], pa.Array) else pa.array(columns[name], kind)) if name in columns else pa.nulls(rows, kind) for name, kind in _FIELDS], names=[name for name, _ in _FIELDS])


def _encode(path: str):
    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, sent = held_encoder(path), {}
        for batch in byte_rows(SLICE_BYTES, batches):
            ids, offsets = encoder.encode(batch.column(1))
            cuts = cut_points(ids, offsets)
            begin = np.concatenate([[0], cuts[:-1]])
            wide = np.maximum.reduceat(ids, begin) > 0xFFFF
            raw, short = ids.astype("<u4").tobytes(), ids.astype("<u2").tobytes()
            sha = hashlib.sha256
            digests = [sha(raw[a:b]).digest() for a, b in zip((4 * begin).tolist(), (4 * cuts).tolist())]
            first: dict[bytes, int] = {}
            for i, d in enumerate(digests):
                if d not in sent:
                    first.setdefault(d, i)
            if len(sent) + len(first) > SENT:
                sent = {}
            sent.update(first)
            own = np.fromiter(first.values(), np.int64, len(first))
            a, b = begin[own].tolist(), cuts[own].tolist()
            yield _batch(
                len(own), kind=["chunk"] * len(own), route=_routes(first), digest=list(first), n=(cuts - begin)[own], wide=wide[own],
                payload=[raw[4 * x : 4 * y] if w else short[2 * x : 2 * y] for x, y, w in zip(a, b, wide[own].tolist())],
            )
            together = b"".join(digests)
            edge = [0, *(np.searchsorted(cuts, offsets[1:]) + 1).tolist()]
            mine = [together[32 * a : 32 * b] for a, b in zip(edge, edge[1:])]
            size = (cuts - begin).astype("<i8").tobytes()
            yield _batch(
                len(mine), kind=["recipe"] * len(mine), route=_routes([sha(m).digest() for m in mine]), doc_id=batch.column(0), digests=mine, sizes=[size[8 * a : 8 * b] for a, b in zip(edge, edge[1:])]
            )

    return run


def _once(batches):
    """Drop chunks that repeat: the partition, the owner of their digests, comes sorted by them."""
    _held.clear()
    last = None
    for batch in batches:
        digests = batch.column(3)
        if not batch.num_rows:
            continue
        before = pa.concat_arrays([pa.array([last], pa.binary()), digests.slice(0, batch.num_rows - 1)])
        last = digests[batch.num_rows - 1].as_py()
        yield batch.filter(pc.fill_null(pc.not_equal(digests, before), True))


def _number(batches):
    """Recipes of one sorted part, numbered, with the ids before each in the part and each one's Merkle root."""
    from pyspark import TaskContext

    part, row, before = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        roots, inner, n = [], [], []
        for digests, sizes in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            roots.append(merkle([digests[i : i + 32] for i in range(0, len(digests), 32)]))
            n.append(int(np.frombuffer(sizes, "<i8").sum()))
            inner.append(before)
            before += n[-1]
        k = batch.num_rows
        yield pa.RecordBatch.from_arrays(
            [pa.array([part] * k, pa.int32()), pa.array(range(row, row + k), pa.int64()), batch.column(0), pa.array(inner, pa.int64()), pa.array(n, pa.int64()), batch.column(2), batch.column(3), pa.array(roots, pa.binary())],
            names=["part", "row", "doc_id", "inner", "n", "digests", "sizes", "root"],
        )
        row += k


INDEX = "part int, row long, doc_id long, inner long, n long, digests binary, sizes binary, root binary"


def _part_root(table: pa.Table) -> pa.Table:
    table = table.sort_by("row")
    return pa.table({"part": pa.array([table["part"][0].as_py()], pa.int32()), "ids": pa.array([sum(table["n"].to_pylist())], pa.int64()), "root": pa.array([merkle(table["root"].to_pylist())], pa.binary())})


def write_store(docs: DataFrame, scratch: Scratch, path: str | None = None) -> None:
    """Encode all texts and write store, index and manifest below the scratch folder."""
    spark = scratch.spark
    parts = parts_for(docs)
    texts = narrowed(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = texts.mapInArrow(_encode(path or vocabulary_path()), ROW).repartition(parts, "route").sortWithinPartitions("digest").mapInArrow(_once, ROW)
    rows.write.mode("overwrite").option("compression", "zstd").partitionBy("kind").parquet(f"{scratch.root}/store")
    # parts are ranges of doc_id and, where that repeats, of the recipe's digest: short keys, since they are sampled by the driver
    recipes = spark.read.schema(ROW).parquet(f"{scratch.root}/store").filter("kind = 'recipe'").select("doc_id", "route", "digests", "sizes")
    ordered = recipes.repartitionByRange(parts, "doc_id", "route").sortWithinPartitions("doc_id", "route", "digests")
    index = scratch.put("index", ordered.mapInArrow(_number, INDEX))
    roots = index.select("part", "row", "n", "root").groupBy("part").applyInArrow(_part_root, "part int, ids long, root binary")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    scratch.put("manifest", roots.select("part", "ids", "root", F.coalesce(F.sum("ids").over(earlier), F.lit(0)).alias("first")))


# ---------------------------------------------------------------- reading
def _check_chunks(batches):
    for batch in batches:
        crc, n, good = [], [], []
        for digest, size, wide, payload in zip(*[batch.column(i).to_pylist() for i in range(4)]):
            raw = np.frombuffer(payload, "<u4" if wide else "<u2").astype("<u4").tobytes()
            crc.append(zlib.crc32(raw))
            n.append(len(raw) // 4)
            good.append(len(raw) == 4 * size and hashlib.sha256(raw).digest() == digest)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(crc, pa.int64()), pa.array(n, pa.int64()), pa.array(good)], names=["digest", "crc", "held", "good"])


def _refs(batches):
    """One row for each chunk of each document: its digest and the ids that follow it in the document."""
    for batch in batches:
        cols = [batch.column(i) for i in range(batch.num_columns)]
        each, sizes, k, good = [], [], [], []
        for digests, size, root in zip(cols[5].to_pylist(), cols[6].to_pylist(), cols[7].to_pylist()):
            mine = [digests[i : i + 32] for i in range(0, len(digests), 32)]
            each += mine
            sizes.append(np.frombuffer(size, "<i8"))
            k.append(len(mine))
            good.append(merkle(mine) == root)
        k, size = np.array(k), np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        upto = np.cumsum(size)
        total = upto[np.cumsum(k) - 1]
        spread = lambda c: np.repeat(c.to_numpy(zero_copy_only=False), k)
        yield pa.RecordBatch.from_arrays(
            [pa.array(spread(cols[0]), pa.int32()), pa.array(spread(cols[1]), pa.int64()), pa.array(each, pa.binary()), pa.array(size, pa.int64()), pa.array(np.repeat(total, k) - upto, pa.int64()), pa.array(np.repeat(good, k))],
            names=["part", "row", "digest", "size", "after", "root_good"],
        )


def crc_shift(crc: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """CRC-32 register (without pre- and post-inversion terms) after `zeros` more zero bytes: one matrix a binary digit."""
    crc = crc.astype(np.uint32)
    matrix = _byte_matrix()
    left = zeros.astype(np.int64)
    while (left > 0).any():
        odd = (left & 1).astype(bool)
        crc[odd] = _apply(matrix, crc[odd])
        matrix = _apply(matrix, matrix)
        left >>= 1
    return crc


def _byte_matrix() -> np.ndarray:
    """Image of each of the 32 bits of a CRC-32 register under one zero byte."""
    rows = np.uint32(1) << np.arange(32, dtype=np.uint32)
    for _ in range(8):
        rows = np.where(rows & np.uint32(1), (rows >> np.uint32(1)) ^ np.uint32(0xEDB88320), rows >> np.uint32(1))
    return rows


def _apply(matrix: np.ndarray, crc: np.ndarray) -> np.ndarray:
    out = np.zeros_like(crc)
    for b in range(32):
        out ^= np.where((crc >> np.uint32(b)) & np.uint32(1), matrix[b], np.uint32(0))
    return out


def _shifted(batches):
    for batch in batches:
        crc = crc_shift(batch.column(2).to_numpy(), 4 * batch.column(3).to_numpy())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(crc.astype(np.int64)), batch.column(4), batch.column(5)], names=["part", "row", "crc", "size", "good"])


def read_store(scratch: Scratch) -> DataFrame:
    """From the files: doc_id, start, n_tokens, ids_crc32, verified.  Chunks are decoded where they lie; ids never move.

    The CRC-32 of a document is the exclusive-or of its chunks' CRC-32s, each shifted by the bytes that follow it.
    """
    spark, root = scratch.spark, scratch.root
    store = spark.read.schema(ROW).parquet(f"{root}/store")
    chunks = store.filter("kind = 'chunk'").select("digest", "n", "wide", "payload").mapInArrow(_check_chunks, "digest binary, crc long, held long, good boolean")
    index, manifest = spark.read.schema(INDEX).parquet(f"{root}/index"), spark.read.parquet(f"{root}/manifest")
    refs = index.select("part", "row", "doc_id", "inner", "n", "digests", "sizes", "root").mapInArrow(_refs, "part int, row long, digest binary, size long, after long, root_good boolean")
    met = refs.join(chunks, "digest", "left").select("part", "row", F.coalesce("crc", F.lit(0).cast("long")).alias("crc"), "after", "size", (F.coalesce("good", F.lit(False)) & (F.col("held") == F.col("size")) & F.col("root_good")).alias("good"))
    sums = met.mapInArrow(_shifted, "part int, row long, crc long, size long, good boolean").groupBy("part", "row").agg(F.bit_xor("crc").alias("ids_crc32"), F.sum("size").alias("n_tokens"), F.bool_and(F.coalesce("good", F.lit(False))).alias("chunks_good"))
    again = index.select("part", "row", "n", "root").groupBy("part").applyInArrow(_part_root, "part int, ids long, root binary").select("part", F.col("root").alias("root2"))
    parts = manifest.join(again, "part").select("part", "first", (F.col("root") == F.col("root2")).alias("part_good"))
    return (
        index.select("part", "row", "doc_id", "inner")
        .join(sums, ["part", "row"])
        .join(parts, "part")
        .select("doc_id", (F.col("first") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32", (F.col("chunks_good") & F.col("part_good")).alias("verified"))
    )


def _places(batches):
    """One row for each chunk of each document, numbered within it."""
    for batch in batches:
        lists = [[d[i : i + 32] for i in range(0, len(d), 32)] for d in batch.column(4).to_pylist()]
        k = np.array([len(x) for x in lists], np.int64)
        rows = np.repeat(np.arange(len(k)), k)
        keep = [batch.column(i).take(pa.array(rows)) for i in range(4)]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(ragged_arange(k)), pa.array([d for x in lists for d in x], pa.binary())], names=["part", "row", "doc_id", "inner", "place", "digest"])


def _together(batches):
    """Payloads of sorted rows (part, row, doc_id, inner, place, wide, payload) put together, document by document."""
    key, doc, held = None, None, []

    def out():
        ids = np.concatenate(held).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([doc[0]], pa.int64()), pa.array([doc[1]], pa.int64()), pa.array([ids], pa.list_(pa.int64()))], names=["part", "doc_id", "inner", "ids"])

    for batch in batches:
        for part, row, doc_id, inner, wide, payload in zip(*[batch.column(c).to_pylist() for c in ("part", "row", "doc_id", "inner", "wide", "payload")]):
            if key is not None and (part, row) != key:
                yield out()
                held = []
            if payload is None:
                raise ValueError(f"a chunk of document {doc_id} is missing")
            key, doc = (part, row), (doc_id, inner)
            held.append(np.frombuffer(payload, "<u4" if wide else "<u2"))
    if key is not None:
        yield out()


def read_ids(scratch: Scratch) -> DataFrame:
    """Every document's ids, put together from its recipe and the chunks: doc_id, start, ids (array of long).

    Chunks meet their documents by digest; each document is then one run of sorted rows, held one at a time.
    """
    spark, root = scratch.spark, scratch.root
    chunks = spark.read.schema(ROW).parquet(f"{root}/store").filter("kind = 'chunk'").select("digest", "wide", "payload")
    index, manifest = spark.read.schema(INDEX).parquet(f"{root}/index"), spark.read.parquet(f"{root}/manifest")
    places = index.select("part", "row", "doc_id", "inner", "digests").mapInArrow(_places, "part int, row long, doc_id long, inner long, place long, digest binary")
    met = places.join(chunks, "digest", "left").repartition(parts_for(index), "part", "row").sortWithinPartitions("part", "row", "place")
    ids = met.select("part", "row", "doc_id", "inner", "place", "wide", "payload").mapInArrow(_together, "part int, doc_id long, inner long, ids array<long>")
    return ids.join(manifest.select("part", "first"), "part").select("doc_id", (F.col("first") + F.col("inner")).alias("start"), "ids")


def store_and_read(docs: DataFrame, scratch: Scratch) -> DataFrame:
    write_store(docs, scratch)
    return read_store(scratch)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: every document, written and read back; a document that fails verification stops the query."""
    found = store_and_read(load(spark, sf_dir, "documents"), Scratch(spark, "token_store"))
    return found.filter(F.when(F.col("verified"), F.lit(True)).otherwise(F.raise_error(F.lit("the store does not verify")).cast("boolean"))).drop("verified")


ORACLE = None  # a tokenizer is no SQL function; the tests compare with the library
