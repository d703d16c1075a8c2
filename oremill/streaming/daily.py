"""Streams of evidence and outcomes: windowed counts with a watermark, duplicates and leaders dropped on arrival, retention by state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.scratch import Scratch

#: fixed values: the events that a landing page reports
LANDING_EVENTS = ("view", "variant_seen", "cta_click", "checkout_start", "payment_success")
LANDING_SCHEMA = "name string, variant string, idea_id string, at timestamp, payload map<string,string>"


def daily_counts(events: DataFrame, at: str, key: str, late: str = "2 days") -> DataFrame:
    """Rows by day and key; rows later than `late` behind the newest are left out of days already closed."""
    return events.withWatermark(at, late).groupBy(F.window(at, "1 day").alias("w"), key).agg(F.count("*").alias("n")).select(F.to_date("w.start").alias("day"), key, "n")


def sliding_counts(events: DataFrame, at: str, key: str, length: str = "90 days", step: str = "1 day", late: str = "2 days") -> DataFrame:
    """Rows by key and window of `length` that ends every `step`: recent, quarterly and long-term activity."""
    return events.withWatermark(at, late).groupBy(F.window(at, length, step).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def first_seen(rows: DataFrame, at: str, key: str = "content_hash", late: str = "2 days") -> DataFrame:
    return rows.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def leaders(rows: DataFrame, at: str, block: str, threshold: float, late: str = "2 days") -> DataFrame:
    """(id, leader): rows (id, embedding) join the most similar leader of their block, or lead; leaders older than `late` are forgotten.

    The state of a block is its leaders' vectors, so blocks should be fine enough for one task each.
    """
    schema = "id string, leader string"

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        names, flat = (list(state.get[0]), list(state.get[1])) if state.exists else ([], [])
        for pdf in frames:
            out = []
            for name, vector in sorted(zip(pdf["id"], pdf["embedding"]), key=lambda r: r[0]):
                v = np.asarray(vector if vector is not None else [], float)
                size = np.linalg.norm(v)
                held = np.array(flat).reshape(len(names), -1) if names else np.zeros((0, len(v)))
                cos = held @ (v / size) if size and held.shape[1] == len(v) else np.zeros(0)
                if len(cos) and cos.max() >= threshold:
                    out.append((name, names[int(cos.argmax())]))
                    continue
                out.append((name, name))
                if size and (not names or held.shape[1] == len(v)):
                    names.append(name)
                    flat += (v / size).tolist()
            yield pd.DataFrame(out, columns=["id", "leader"])
        state.update((names, flat))
        state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + 1 + int(pd.Timedelta(late).total_seconds() * 1000))

    marked = rows.withWatermark(at, late).groupBy(block)
    return marked.applyInPandasWithState(run, schema, "names array<string>, vectors array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def kept_until(rows: DataFrame, at: str, policy: DataFrame) -> DataFrame:
    """`rows` with the day from which their source's retention no longer holds them; those that are past it on arrival are dropped."""
    p = F.broadcast(policy.select(F.col("source").alias("p_source"), "retention_days"))
    until = F.date_add(F.to_date(at), F.col("retention_days"))
    held = rows.join(p, F.col("source") == F.col("p_source"), "left").withColumn("keep_until", until).drop("p_source", "retention_days")
    return held.filter("keep_until IS NULL OR keep_until >= current_date()")


def landing_counts(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Known landing events (LANDING_SCHEMA) by hour, idea, variant and name."""
    known = events.filter(F.col("name").isin(*LANDING_EVENTS) & F.col("variant").isin("a", "b")).withWatermark("at", late)
    return known.groupBy(F.window("at", "1 hour").alias("w"), "idea_id", "variant", "name").agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "idea_id", "variant", "name", "n")


def run_available(stream: DataFrame, scratch: Scratch, name: str, mode: str = "complete") -> DataFrame:
    """Process what is there and stop; the result is a table below the scratch folder.

    In complete mode every batch replaces the table, else it is added to; the checkpoint lies beside it, so a second run
    goes on where the first one ended.
    """
    path = f"{scratch.root}/{name}"
    begun = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True)
    if mode == "append":
        query = begun.format("parquet").start(path)
    else:
        query = begun.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path)).start()
    query.awaitTermination()
    return scratch.spark.read.schema(stream.schema).parquet(path)
