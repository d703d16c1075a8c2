"""Hooks for services that a run may be given: a language model and an embedder, as functions of text.

The engine opens no connection of its own.  A hook runs on the executors, batch by batch, so it must be picklable.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import AnswerNotJson, EmbeddingUnavailable
from ..functions import text as t
from . import payloads

SNIPPET_CHARS = 600
CLAIM = "array<struct<evidence_id:string,claim_type:string,persona:string,job:string,obstacle:string,current_workaround:string,urgency:double,price_signal:string,incumbents:array<string>>>"


def embedded(rows: DataFrame, text: Column, embed: Callable[[list[str]], list[list[float]]], batch: int = 16) -> DataFrame:
    """`rows` with embedding, `batch` texts a call; an answer that lacks a vector fails the query."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            texts, vectors = pdf.pop("__text").tolist(), []
            for i in range(0, len(texts), batch):
                part = texts[i : i + batch]
                found = embed(part)
                if len(found) != len(part):
                    raise EmbeddingUnavailable(f"{len(found)} vectors for {len(part)} texts")
                vectors += [[float(x) for x in v] for v in found]
            yield pdf.assign(embedding=vectors)

    plain = rows.drop("embedding")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields)
    return plain.withColumn("__text", F.coalesce(text, F.lit(""))).mapInPandas(run, f"{schema}, embedding array<double>")


def embedding_state(has_vectors: bool, has_embedder: bool, allowed: bool) -> str:
    """How a run got its vectors: cached, local or unavailable."""
    return "cached" if has_vectors else "local" if has_embedder and allowed else "unavailable"


def claim_prompts(originals: DataFrame, key: str, most: int = 24, size: int = 6) -> DataFrame:
    """(key, batch, prompt): of each key's first `most` rows, `size` a prompt, one JSON line a row with its first SNIPPET_CHARS characters.

    A model is asked about few rows by design; what it does not read, heuristics do.
    """
    # lines are cut before they are dealt, and numbers are compared as they are, so that each task sends `most` lines of a key at most
    cut = originals.select(key, "ord", F.to_json(F.struct("id", "title", t.cut(F.col("snippet"), SNIPPET_CHARS).alias("snippet"))).alias("line"))
    number = F.row_number().over(Window.partitionBy(key).orderBy("ord"))
    first = cut.withColumn("number", number).filter(F.col("number") <= most).withColumn("place", F.col("number") - 1)
    each = first.select(key, F.floor(F.col("place") / size).cast("int").alias("batch"), F.struct("place", "line").alias("l"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["line"]), "\n")
    ask = F.lit("State as a JSON list each pain, workaround or wish that these rows express, with the evidence_id it rests on:\n")
    return each.groupBy(key, "batch").agg(F.concat(ask, lines).alias("prompt"))


def answered(prompts: DataFrame, chat: Callable[[str], str | None]) -> DataFrame:
    """`prompts` with answer; a prompt that the model refuses or fails on has none."""

    def run(texts: pd.Series) -> pd.Series:
        def one(p: str) -> str | None:
            try:
                return chat(p)
            except Exception:  # noqa: BLE001  a service may fail in any way; its batch then has no answer
                return None

        return texts.map(one)

    return prompts.withColumn("answer", F.pandas_udf(run, "string")("prompt"))


def model_claims(answers: DataFrame, known: DataFrame, version: str) -> DataFrame:
    """Claims from answers; what is no JSON list, or cites a row that was not shown (`known`: id), is dropped."""
    rows = answers.select(F.explode(F.from_json(t.strip_fences(F.col("answer")), CLAIM)).alias("c")).select("c.*")
    shown = known.select(F.col("id").alias("evidence_id"))
    return rows.filter("evidence_id IS NOT NULL").join(shown, "evidence_id", "left_semi").withColumn("model_version", F.lit(version))


def require_json(answers: DataFrame) -> None:
    """Raises unless every answer holds JSON."""
    bad = answers.filter(F.try_parse_json(t.strip_fences(F.col("answer"))).isNull()).limit(1).collect()
    if bad:
        raise AnswerNotJson("an answer holds no JSON")


def expanded(answer: DataFrame, seeds: DataFrame, held: DataFrame, limit: int = 10) -> DataFrame:
    """New queries (text, ord) from a model's answer (answer: a JSON list of objects with text) beyond `seeds` and `held`; none if it is no list."""
    proposed = answer.select(F.posexplode(F.from_json(t.strip_fences(F.col("answer")), "array<struct<text:string>>")).alias("ord", "q")).select(F.col("q.text").alias("text"), "ord")
    known = seeds.select("text").unionByName(held.select("text"))
    return payloads.sanitised(proposed.filter("text IS NOT NULL"), known, limit)
