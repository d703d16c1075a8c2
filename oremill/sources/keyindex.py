"""An index of the keys of all earlier runs: files by a hash of the key, a Bloom filter a file, and an exact look-up behind it.

A run adds one segment.  Its keys are dealt to files of about FILE_KEYS by a hash; each file's filter is built from its keys.
A look-up sends hashes of the wanted keys to the filters of the files they would lie in, and reads only files of which a
filter says yes; there keys are compared themselves.  A segment counts once its filters are written whole, and a run that
is repeated writes its segment anew, so that a failed or repeated run leaves no trace.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch

FILE_KEYS = 1 << 20
BITS_A_KEY = 10
PROBES = 5
#: Hashes that one task tests at a time.
WANTED = 1 << 21


def _places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The PROBES bit numbers of each hash, by double hashing; `bits` is a power of two."""
    h = hashes.astype(np.int64).view(np.uint64)
    step = (h >> np.uint64(33)) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
    return (h[:, None] + np.arange(PROBES, dtype=np.uint64) * step[:, None]) & np.uint64(bits - 1)


def _filter(table: pa.Table) -> pa.Table:
    """One file's hashes to its filter."""
    bits = 1 << max(6, (BITS_A_KEY * table.num_rows - 1).bit_length())
    held = np.zeros(bits, bool)
    held[_places(table["h"].to_numpy(), bits)] = True
    return pa.table({"bucket": table["bucket"][:1], "bits": pa.array([np.packbits(held, bitorder="little").tobytes()], pa.binary())})


def _test(wanted: pa.Table, filters: pa.Table) -> pa.Table:
    """The wanted hashes that a file's filter does not rule out."""
    if not filters.num_rows or not wanted.num_rows:
        return wanted.slice(0, 0).select(["run", "bucket", "h"])
    held = np.unpackbits(np.frombuffer(filters["bits"][0].as_py(), np.uint8), bitorder="little")
    found = held[_places(wanted["h"].to_numpy(), len(held))].all(axis=1)
    return wanted.filter(pa.array(found)).select(["run", "bucket", "h"])


class KeyIndex:
    """Below one folder: keys/run=R/bucket=B (key, h, id) and filters/R (run, buckets, bucket, bits)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def runs(self) -> list[str]:
        """Runs whose segment is whole."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/filters")
        if not self._fs.exists(folder):
            return []
        found = (s.getPath() for s in self._fs.listStatus(folder))
        return sorted(p.getName() for p in found if self._fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{p.toString()}/_SUCCESS")))

    def add(self, run: str, keys: DataFrame) -> None:
        """A segment of `keys` (key, id), each key once."""
        for kind in ("filters", "keys"):  # a segment without filters does not count
            self._fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{kind}/{'run=' if kind == 'keys' else ''}{run}"), True)
        buckets = max(1, -(-keys.count() // FILE_KEYS))
        path, h = f"{self.root}/keys/run={run}", F.xxhash64("key")
        dealt = keys.select("key", "id", h.alias("h"), F.pmod(h, F.lit(buckets)).alias("bucket"))
        dealt.repartition(buckets, "bucket").write.partitionBy("bucket").parquet(path)
        held = self.spark.read.schema("h long, bucket long").parquet(path)
        made = held.groupBy("bucket").applyInArrow(_filter, "bucket long, bits binary")
        made.select(F.lit(run).alias("run"), F.lit(buckets).cast("long").alias("buckets"), "bucket", "bits").write.parquet(f"{self.root}/filters/{run}")

    def candidates(self, keys: DataFrame, runs: list[str]) -> DataFrame:
        """(run, bucket, h): files that the filters of these runs do not rule out, for the distinct `keys` (key)."""
        stored = lambda: self.spark.read.schema("run string, buckets long, bucket long, bits binary").parquet(*[f"{self.root}/filters/{r}" for r in runs])
        filters, sizes = stored(), F.broadcast(stored().select("run", "buckets").distinct())  # a row a run
        wanted = keys.select(F.xxhash64("key").alias("h")).join(sizes).select("run", F.pmod("h", "buckets").alias("bucket"), "h")
        parts = max(1, -(-keys.count() // WANTED))
        left = wanted.withColumn("part", F.pmod(F.hash("h"), F.lit(parts)).cast("long"))
        right = filters.select("run", "bucket", "bits", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"))
        by = ("run", "bucket", "part")
        return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(_test, "run string, bucket long, h long")

    def files(self, candidates: DataFrame) -> list[str]:
        """Folders of the files that a look-up has to read: a name a file at most."""
        return [f"{self.root}/keys/run={r['run']}/bucket={r['bucket']}" for r in candidates.select("run", "bucket").distinct().orderBy("run", "bucket").collect()]

    def look_up(self, keys: DataFrame, scratch: Scratch, but: str | None = None) -> DataFrame:
        """(key, first_id) of those distinct `keys` (key) that a run other than `but` holds; the earliest run's id."""
        runs = [r for r in self.runs() if r != but]
        files = self.files(scratch.put(self.candidates(keys, runs))) if runs else []
        if not files:
            return keys.select("key", F.lit(None).cast("string").alias("first_id")).limit(0)
        held = self.spark.read.schema("key string, id string, run string").option("basePath", f"{self.root}/keys").parquet(*files)
        return held.join(keys.select("key"), "key", "left_semi").groupBy("key").agg(F.min_by("id", "run").alias("first_id"))

    def first_seen(self, rows: DataFrame, run: str, scratch: Scratch) -> DataFrame:
        """`rows` (id, key, ord) with `original`: the row that had the key first, in an earlier run or in this one.

        Runs are named in the order in which they count.  Rows without a key (null or empty) are their own originals and
        are not indexed.  Keys that are new make the run's segment.
        """
        rows = scratch.put(rows)
        firsts = scratch.put(rows.filter("key <> ''").groupBy("key").agg(F.min_by("id", "ord").alias("id")))
        known = scratch.put(self.look_up(firsts.select("key"), scratch, run))
        self.add(run, firsts.join(known.select("key"), "key", "left_anti"))
        original = firsts.join(known, "key", "left").select("key", F.coalesce("first_id", "id").alias("original"))
        return rows.join(original, "key", "left").withColumn("original", F.coalesce("original", "id")).select(*rows.columns, "original")
