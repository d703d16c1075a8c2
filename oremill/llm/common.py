"""Helpers shared by the corpus operators: scratch tables, text buffers and vectorised word hashes.

Every function that runs on executors takes and returns numpy arrays cut from Arrow buffers, so that no
operator loops over words in Python.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ten ASCII white-space bytes' complement: bytes of a word `[^\x20\x09-\x0D]+`.
SPACE_WORD = np.ones(256, dtype=bool)
SPACE_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Bytes of a word `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` once A-Z are lower-cased.
ALNUM_WORD = np.zeros(256, dtype=bool)
ALNUM_WORD[0x30:0x3A] = True
ALNUM_WORD[0x61:0x7B] = True
ALNUM_WORD[0x80:] = True
#: Lower-cases A-Z and leaves every other byte alone.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


# ---------------------------------------------------------------- scratch space
def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; only where it is unset and all run in one process, one of our own."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        held = sc._jsc.sc().getCheckpointDir()
        if held.isDefined():
            named = held.get()
        elif sc.master.startswith("local"):
            named = tempfile.mkdtemp(prefix="oremill-")
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(named)
    return named.rstrip("/")


class Scratch:
    """Parquet tables of one operator run, below the shared folder; `drop` removes one as soon as it has served.

    As a context it removes all of them if the run fails, and all but what `finish` wrote if it does not.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/oremill/{name}-{uuid.uuid4().hex[:12]}"
        self.tables: list[str] = []

    def __enter__(self) -> "Scratch":
        return self

    def __exit__(self, kind, error, trace) -> None:
        if kind is not None:
            self.clear()

    def clear(self, keep: str | None = None) -> None:
        """Remove every table but `keep`."""
        for table in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self.tables = []
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for held in fs.listStatus(path) if fs.exists(path) else []:
            if held.getPath().getName() != keep:
                fs.delete(held.getPath(), True)

    def finish(self, df: DataFrame) -> DataFrame:
        """Write the result and remove everything that led to it."""
        out = self.put("out", df)
        self.clear("out")
        return out

    def put(self, name: str, df: DataFrame) -> DataFrame:
        """Write `df` and read it back: a cut of the lineage that survives the loss of any executor."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def put_bucketed(self, name: str, df: DataFrame, key: str, buckets: int) -> DataFrame:
        """As `put`, clustered into `buckets` by `key`: later groupings on `key` need no shuffle of this side."""
        table = f"oremill_{name}_{uuid.uuid4().hex[:12]}"
        (
            df.repartition(buckets, key)
            .write.bucketBy(buckets, key)
            .mode("overwrite")
            .format("parquet")
            .option("compression", "zstd")
            .option("path", f"{self.root}/{name}")
            .saveAsTable(table)
        )
        self.tables.append(table)
        return self.spark.table(table)

    def put_kinds(self, name: str, df: DataFrame, key: str, buckets: int) -> DataFrame:
        """Write rows already dealt by `key`, apart by their column `kind` and clustered by `key`."""
        table = f"oremill_{name}_{uuid.uuid4().hex[:12]}"
        df.write.partitionBy("kind").bucketBy(buckets, key).mode("overwrite").format("parquet").option("compression", "zstd").option("path", f"{self.root}/{name}").saveAsTable(table)
        self.tables.append(table)
        return self.spark.table(table)

    def drop(self, *names: str) -> None:
        """Remove the named tables, or all but the results still to be read."""
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        for table in [t for t in self.tables if t.split("_")[1] in names]:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
            self.tables.remove(table)


    def release(self) -> None:
        """Let Spark delete the shuffle files of finished exchanges now, rather than whenever the driver collects garbage."""
        gc.collect()
        self.spark._jvm.System.gc()


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def narrowed(df: DataFrame, *cols: str) -> DataFrame:
    """Only the named columns: extra columns, whatever their names, never reach an operator's own ones."""
    return df.select(*[F.col(f"`{c}`") for c in cols])


def parts_for(df: DataFrame, part_bytes: int = 128 << 20) -> int:
    """Partitions for an exchange of rows like those of `df`: spark.sql.shuffle.partitions, or more if the size of the files it reads asks for them."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    known = sum(size for size in sizes if size < 1 << 60)  # relations that are no files have no size
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), known // part_bytes + 1)


def text_bytes(df: DataFrame, col: str = "text") -> int:
    """Bytes of all texts (UTF-8), by one aggregation."""
    return int(df.agg(F.sum(F.octet_length(F.col(col)).cast("long")).alias("b")).first()["b"] or 0)


# ---------------------------------------------------------------- Arrow text buffers
def flatten(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column in one array and the n + 1 offsets of its rows; null reads as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.large_string())
    arr = pc.fill_null(col.cast(pa.large_binary()), b"")
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = arr.buffers()
    offsets = np.frombuffer(off, np.int64)[arr.offset : arr.offset + len(arr) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_bounds(buf: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the n + 1 offsets of each row's words among them."""
    if len(buf) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    mask = member[buf]
    begins, ends = mask.copy(), mask.copy()
    begins[1:] &= ~mask[:-1]
    ends[:-1] &= ~mask[1:]
    inner = offsets[:-1][np.diff(offsets) > 0]
    begins[inner] = mask[inner]
    last = offsets[1:][np.diff(offsets) > 0] - 1
    ends[last] = mask[last]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


# ---------------------------------------------------------------- hashes
_SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Words beyond this many bytes are hashed by the xxhash library, one by one.
LANES = 8
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, one to one: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def join_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of an ordered pair of hashes."""
    return mix(a * np.uint64(0x9E3779B97F4A7C15) + (b ^ np.uint64(0x165667B19E3779F9)))


def lanes_of(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one little-endian number; beyond the end of the buffer they are zero."""
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    return np.ndarray(len(buf) + 1, "<u8", padded, strides=(1,))


def masked(lane: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The first `size` bytes (at most 8) of each lane."""
    return lane & _MASKS[np.minimum(size, 8)]


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each word; `which` picks one of two functions.

    Words of up to seven bytes have hashes of their own (a one-to-one function of bytes and length).  Longer ones are
    taken in eight bytes at a time, each lane mixed into the state of those before it, so that the order and place of
    every byte counts; words beyond 8 x LANES bytes go through xxhash.
    """
    seed, lanes = np.uint64(_SEEDS[which]), lanes_of(buf)
    size = ends - starts
    first = masked(lanes[starts], size)
    short = size < 8
    first[short] |= size[short].astype(np.uint64) << np.uint64(56)
    out = mix(first ^ seed)
    more = np.flatnonzero((size > 8) & (size <= 8 * LANES))
    state, at, left = out[more], starts[more] + 8, size[more] - 8
    while len(more):
        state = mix((state ^ masked(lanes[at], left)) * np.uint64(0x9FB21C651E98DF25) + seed)
        out[more] = state
        go = left > 8
        more, state, at, left = more[go], state[go], at[go] + 8, left[go] - 8
    long = np.flatnonzero(~short)
    out[long] = mix(out[long] ^ (size[long].astype(np.uint64) * np.uint64(0x27D4EB2F165667C5) + seed))
    for i in np.flatnonzero(size > 8 * LANES).tolist():
        out[i] = xxhash.xxh3_64_intdigest(buf[starts[i] : ends[i]].tobytes(), _SEEDS[which])
    return out


def same_words(buf, starts, ends, other, other_starts, other_ends, a: np.ndarray | None = None, b: np.ndarray | None = None) -> np.ndarray:
    """True where the bytes of a word of `buf` are those of the word of `other` in the same place: byte by byte.

    `a` and `b` are the lanes of the two buffers, where the caller has them.
    """
    size = ends - starts
    same = size == other_ends - other_starts
    a, b = lanes_of(buf) if a is None else a, lanes_of(other) if b is None else b
    at, k = np.flatnonzero(same & (size > 0)), 0
    while len(at) and k < 8 * LANES:
        left = size[at] - k
        good = masked(a[starts[at] + k], left) == masked(b[other_starts[at] + k], left)
        same[at[~good]] = False
        at, k = at[good & (left > 8)], k + 8
    for i in at.tolist():
        same[i] = buf[starts[i] : ends[i]].tobytes() == other[other_starts[i] : other_ends[i]].tobytes()
    return same


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on (also across rows; callers mask those), by doubling."""
    if n == 1 or len(words) < n:
        return words if n == 1 else np.zeros(0, np.uint64)
    half = n // 2
    part = gram_hashes(words, half)
    size = len(words) - n + 1
    both = join_hash(part[:size], part[half : half + size])
    return join_hash(both, words[n - 1 : n - 1 + size]) if n % 2 else both


def positions_in_rows(bounds: np.ndarray, n: int) -> np.ndarray:
    """True at each position from which n words lie in one row; length max(words - n + 1, 0)."""
    total = int(bounds[-1])
    if total < n:
        return np.zeros(0, bool)
    row_end = np.repeat(bounds[1:], np.diff(bounds))
    return np.arange(total - n + 1) + n <= row_end[: total - n + 1]


def find_sorted(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Index into the sorted `keys` of each wanted value, or -1."""
    if len(keys) == 0:
        return np.full(len(wanted), -1, np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def ragged_arange(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count c, one after another."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)


def covered(starts: np.ndarray, length: int, total: int) -> np.ndarray:
    """Mask over `total` positions of those inside any window of `length` that begins at one of `starts`."""
    change = np.zeros(total + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + length, total), -1)
    return np.cumsum(change[:-1]) > 0


def settle() -> None:
    """Give memory that allocators hold back to the system: a Python worker stays while others need the space."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def byte_rows(batch_bytes: int, it):
    """Cut Arrow batches to slices of about `batch_bytes` of their `text` column, so that memory stays bounded."""
    for batch in it:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index("text"))), 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            before = total[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(total, before + batch_bytes, side="right")))
            yield batch.slice(at, stop - at)
            at = stop
    batch = None
    settle()
