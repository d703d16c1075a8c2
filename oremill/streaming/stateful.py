"""Leaders and clusters carried over a stream, and retention by timers: state a group in entries of their own, event time throughout.

Rows wait in state until the watermark has passed them and are then taken in order of event time and id, so that what comes
out does not depend on how rows were dealt to batches.  Only entries that change are written; what is too old goes by a timer.
State is held by RocksDB on the executors, with its checkpoint beside the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.keyindex import KeyIndex
from ..sources.scratch import Scratch
from .daily import run_available

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT_ROWS = 10_000
#: Timers are set to whole hours, so that a block has few of them.
STEP_MS = 3_600_000


def run_stateful(stream: DataFrame, scratch, name: str) -> DataFrame:
    """`run_available` with the state store that timers and maps need; the session's own choice is put back."""
    conf = scratch.spark.conf
    before = conf.get(PROVIDER, None)
    conf.set(PROVIDER, ROCKSDB)
    try:
        return run_available(stream, scratch, name, "append")
    finally:
        conf.set(PROVIDER, before) if before else conf.unset(PROVIDER)


# ---------------------------------------------------------------- leaders and clusters
class _Held:
    """The live leaders of a block, as matrices by length of vector; `follow` moves a leader by its members."""

    def __init__(self, entries, follow: bool):
        self.follow, self.names, self.at, self.vectors, self.sizes = follow, {}, {}, {}, {}
        for (name,), (at, vector, size) in entries:
            self.add(name, at, np.asarray(vector, float), size)

    def add(self, name: str, at: int, vector: np.ndarray, size: int = 1) -> None:
        d = len(vector)
        n = len(self.names.setdefault(d, []))
        if n == len(self.vectors.get(d, ())):  # room for twice as many
            self.vectors[d] = np.concatenate([self.vectors.get(d, np.zeros((0, d))), np.zeros((max(8, n), d))])
            self.at[d] = np.concatenate([self.at.get(d, np.zeros(0, np.int64)), np.zeros(max(8, n), np.int64)])
            self.sizes[d] = np.concatenate([self.sizes.get(d, np.zeros(0, np.int64)), np.zeros(max(8, n), np.int64)])
        self.names[d].append(name)
        self.vectors[d][n], self.at[d][n], self.sizes[d][n] = vector, at, size

    def best(self, vector: np.ndarray, since: int) -> tuple[int, float]:
        """The place of the most similar leader that is not older than `since`, the earliest of equals, and the cosine; -1 where there is none."""
        d = len(vector)
        n = len(self.names.get(d, ()))
        live = np.flatnonzero(self.at[d][:n] >= since) if n else np.zeros(0, np.int64)
        if not len(live):
            return -1, 0.0
        m = self.vectors[d][live]
        lengths = np.linalg.norm(m, axis=1) * np.linalg.norm(vector)
        cos = np.divide(m @ vector, lengths, out=np.zeros(len(live)), where=lengths > 0)
        k = int(cos.argmax())
        return int(live[k]), float(cos[k])

    def join(self, d: int, k: int, at: int, vector: np.ndarray) -> None:
        self.sizes[d][k] += 1
        if self.follow:
            self.vectors[d][k] += vector
            self.at[d][k] = at

    def entry(self, d: int, k: int) -> tuple:
        return int(self.at[d][k]), self.vectors[d][k].tolist(), int(self.sizes[d][k])


class _Leaders(StatefulProcessor):
    def __init__(self, threshold: float, keep_ms: int, follow: bool):
        self.threshold, self.keep_ms, self.follow = threshold, keep_ms, follow

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, id string, n long, embedding array<double>")
        self.leaders = handle.getMapState("leaders", "id string", "at long, vector array<double>, size long")
        self.arrived = handle.getValueState("arrived", "n long")
        self.done = {}  # block to the watermark that its rows were taken for, by this task of this batch

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        self.done.pop(key[0], None)
        held = self.arrived.get()
        n, times = (held[0] if held else 0), set()
        for pdf in rows:
            new = []
            for at, name, vector in zip(pdf["at_ms"], pdf["id"], pdf["embedding"]):
                if name is not None:  # else a row that only moves the watermark on
                    n += 1
                    new.append((int(at), name, n, [float(x) for x in vector] if vector is not None else []))
                    times.add(-(-int(at) // STEP_MS) * STEP_MS)
            if new:
                self.waiting.appendList(new)
        self.arrived.update((n,))
        for at in times:
            self.handle.registerTimer(at)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        if self.done.get(key[0]) == now:  # the first timer of a batch took all that is due
            return
        self.done[key[0]] = now
        held = list(self.waiting.get()) if self.waiting.exists() else []
        due = sorted((r for r in held if r[0] <= now), key=lambda r: (r[0], r[1], list(r[3]), r[2]))
        if len(due) == len(held):
            self.waiting.clear()
        elif due:  # what is put back is what came within the time that rows may be late
            self.waiting.put([tuple(r) for r in held if r[0] > now])
        entries = list(self.leaders.iterator())
        for (name,), (at, _, _) in entries:
            if at < now - self.keep_ms:
                self.leaders.removeKey((name,))
        if due:
            yield from self._take(due, _Held(entries, self.follow), now)

    def _take(self, due, held: _Held, now: int) -> Iterator[pd.DataFrame]:
        out, changed = [], set()
        for at, name, _, vector in due:
            v = np.asarray(vector, float)
            k, cos = held.best(v, at - self.keep_ms) if len(v) else (-1, 0.0)
            if k >= 0 and cos >= self.threshold and cos > 0:
                held.join(len(v), k, at, v)
                changed.add((len(v), k))
                out.append((name, held.names[len(v)][k], cos, at))
            else:
                if np.linalg.norm(v) > 0:
                    held.add(name, at, v)
                    changed.add((len(v), len(held.names[len(v)]) - 1))
                out.append((name, name, 1.0, at))
            if len(out) == OUT_ROWS:
                yield self._frame(out)
                out = []
        for d, k in changed:
            entry = held.entry(d, k)
            if entry[0] >= now - self.keep_ms:
                self.leaders.updateValue((held.names[d][k],), entry)
                self.handle.registerTimer(-(-(entry[0] + self.keep_ms + 1) // STEP_MS) * STEP_MS)
        if out:
            yield self._frame(out)

    @staticmethod
    def _frame(out) -> pd.DataFrame:
        pdf = pd.DataFrame(out, columns=["id", "leader", "cos", "at"])
        return pdf.assign(at=pd.to_datetime(pdf["at"], unit="ms"))

    def close(self) -> None:
        pass


def leaders(rows: DataFrame, at: str, block: str, threshold: float, late: str = "2 days", keep: str = "90 days", follow: bool = False) -> DataFrame:
    """(id, leader, cos, at): rows (id, embedding) of a stream join the most similar leader of their block, or lead.

    Rows are taken in order of `at` (to the millisecond) and id once the watermark has passed the hour they end in; a leader serves rows up
    to `keep` after its own time, and is removed from the state when the watermark is further on, whether or not its block
    goes on.  With `follow` leaders are clusters: their vector is the sum of their members', and their time that of the last
    one.  Rows without a vector lead and are followed by none; rows without an id only move the watermark on.

    A batch loads the live leaders of the blocks it touches and writes those that changed.  A block is one task's work, so
    blocks should be as fine as the data allow.
    """
    ms = F.unix_millis(F.col(at)).alias("at_ms")
    marked = rows.withWatermark(at, late).select(F.coalesce(F.col(block).cast("string"), F.lit("")).alias("block"), "id", F.col("embedding").cast("array<double>").alias("embedding"), ms, F.col(at).alias("at"))
    keep_ms = int(pd.Timedelta(keep).total_seconds() * 1000)
    return marked.groupBy("block").transformWithStateInPandas(_Leaders(threshold, keep_ms, follow), "id string, leader string, cos double, at timestamp", "append", "eventTime")


# ---------------------------------------------------------------- keys of all earlier batches
def first_seen_ever(stream: DataFrame, index: KeyIndex, scratch, name: str) -> DataFrame:
    """Rows (id, key, ord) of a stream with the row that had their key first, however long ago; a table below the scratch folder.

    Each batch is one run of the index.  A batch that is repeated after a failure replaces its own rows and segment.
    """
    path = f"{scratch.root}/{name}"

    def take(batch: DataFrame, number: int) -> None:
        with Scratch(batch.sparkSession, f"{name}_batch") as own:
            index.first_seen(batch, f"b{number:012d}", own).write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).foreachBatch(take).start().awaitTermination()
    return scratch.spark.read.schema(stream.schema.add("original", "string")).parquet(path)


# ---------------------------------------------------------------- retention
class _Retention(StatefulProcessor):
    """Ids that are due at one time, and the timer that lets them go."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ids = handle.getListState("ids", "id string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if key[1] < 0:  # never due
            for _ in rows:
                pass
            return iter(())
        for pdf in rows:
            self.ids.appendList([(x,) for x in pdf["id"]])
        self.handle.registerTimer(int(key[1]) + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        for (name,) in self.ids.get():
            out.append(name)
            if len(out) == OUT_ROWS:
                yield self._frame(key, out)
                out = []
        if out:
            yield self._frame(key, out)
        self.ids.clear()

    @staticmethod
    def _frame(key, out) -> pd.DataFrame:
        return pd.DataFrame({"id": out, "source": key[0], "due": pd.to_datetime(int(key[1]), unit="ms")})

    def close(self) -> None:
        pass


def expiring(rows: DataFrame, at: str, policy: DataFrame, late: str = "2 days", step: str = "1 day", shards: int = 16) -> DataFrame:
    """(id, source, due): rows (id, source) of a stream as they leave their source's retention, by the stream's own time.

    A row is due when its source's days after `at` are over, counted up to whole `step`s; it comes out once the watermark has
    passed that.  Sources without a limit, and rows whose source has no policy, never come out and hold no state.  What is
    due together waits in one list a source, time and shard behind one timer, so that no batch scans what is held.
    """
    ms = int(pd.Timedelta(step).total_seconds() * 1000)
    p = F.broadcast(policy.select(F.col("source").alias("p_source"), "retention_days").filter("retention_days IS NOT NULL"))  # a row a source
    met = rows.withWatermark(at, late).join(p, F.col("source") == F.col("p_source"), "left")
    over: Column = F.unix_millis(F.col(at)) + F.col("retention_days").cast("long") * 86_400_000
    # rows that are never due are not filtered here: a filter could move below the watermark, which they would not move on then
    due = F.coalesce((F.ceil(over / ms) * ms).cast("long"), F.lit(-1).cast("long"))
    held = met.select("id", "source", due.alias("due"), F.pmod(F.xxhash64("id"), F.lit(shards)).alias("shard"))
    return held.groupBy("source", "due", "shard").transformWithStateInPandas(_Retention(), "id string, source string, due timestamp", "append", "eventTime")
