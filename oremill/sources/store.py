"""The engine's tables: declared schemas, and a folder of versions that readers never see half-written."""

from __future__ import annotations

import functools
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import WriteConflict
from ..functions.vocabulary import RIGHT_NAMES

_RIGHTS = "struct<" + ",".join(f"{n}:boolean" for n in RIGHT_NAMES) + ">"

#: Columns of the fourteen tables and of the two that hold what arrays of unbounded length would.
TABLES: dict[str, str] = {
    "query": "id string, text string, vertical string, created_at timestamp",
    "source_run": (
        "id string, query_id string, source string, adapter_version string, policy_version int, status string, reason string, "
        "record_count int, started_at timestamp, finished_at timestamp"
    ),
    "evidence_event": (
        "id string, source_run_id string, query_id string, vertical string, source string, url string, canonical_url string, domain string, "
        "title string, snippet string, engine string, score double, published_at string, fetched_at timestamp, language string, "
        "content_hash string, near_dup_key string, intent_labels array<string>, embedding array<double>, embedding_model string, "
        f"is_duplicate_of string, dedupe_stage string, rights_profile {_RIGHTS}, policy_version int"
    ),
    "raw_payload": "evidence_id string, body string, retention_deadline timestamp",
    "text_segment": "id string, evidence_id string, ordinal int, text string",
    "pain_claim": (
        "id string, evidence_id string, claim_type string, persona string, job string, obstacle string, consequence string, "
        "current_workaround string, urgency double, commercial_intent string, price_signal string, incumbents array<string>, "
        "model_version string, confidence double, created_at timestamp"
    ),
    "cluster": (
        "id string, vertical string, algorithm string, label string, member_count long, policy_version int, embedding_model string, created_at timestamp"
    ),
    "cluster_member": "cluster_id string, evidence_id string, place long",
    "problem_hypothesis": (
        "id string, cluster_id string, vertical string, title string, buyer string, job string, pain string, current_workaround string, "
        "current_paid_alternative string, incumbent_failures string, evidence_for long, evidence_against long, channel string, "
        "suggested_form string, pricing_mechanism string, smallest_paid_test string, fastest_mvp string, compliance_status string, created_at timestamp"
    ),
    "hypothesis_evidence": "hypothesis_id string, side string, place long, evidence_id string",
    "product_idea": (
        "id string, hypothesis_id string, vertical string, form string, pitch string, pricing_mechanism string, smallest_paid_test string, "
        "mvp_sketch string, score_total double, score_dimensions map<string,double>, failed_gates array<string>, band string, created_at timestamp"
    ),
    "score_snapshot": "id string, idea_id string, features map<string,double>, total double, created_at timestamp",
    "experiment": "id string, idea_id string, spec string, status string, result string, decision string, decision_reason string, created_at timestamp",
    "outcome": "id string, experiment_id string, kind string, value string, observed_at timestamp",
    "deletion_event": (
        "id string, source string, reason string, deleted long, affected_claims long, affected_segments long, affected_memberships long, created_at timestamp"
    ),
    "deleted_evidence": "deletion_id string, evidence_id string",
}
SCHEMA_VERSION = 1
#: Tables that are read by vertical are laid out by it.
PARTITIONED = {name: "vertical" for name, cols in TABLES.items() if "vertical string" in cols}


def schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[name])


class Store:
    """Tables below one folder; a version of a table is a file that lists its folders.

    Rows are written to a folder with a name of its own, and count once the list that names it is put in place by one
    rename, which fails if the number is taken: what a failed write left behind is in no list, and readers see a change
    whole or not at all.  Parquet has no update or delete: `replace` writes what survives and leaves the old version to
    readers that hold it, until `vacuum`.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def versions(self, name: str) -> list[str]:
        """The lists of a table's versions, oldest first."""
        folder = self._path(f"{self.root}/{name}/_versions")
        if not self._fs.exists(folder):
            return []
        found = [s.getPath() for s in self._fs.listStatus(folder)]
        return sorted(p.toString() for p in found if p.getName().isdigit())

    def folders(self, version: str) -> list[str]:
        """The folders whose rows make up a version."""
        stream = self._fs.open(self._path(version))
        try:
            return [f"{self.root}/{line}" for line in self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split()]
        finally:
            stream.close()

    def _commit(self, name: str, after: list[str], folders: list[str]) -> None:
        """Make `folders` the version that follows the versions `after`; WriteConflict if there is one by now."""
        jvm, number = self.spark._jvm, int(after[-1].rsplit("/", 1)[1]) + 1 if after else 1
        new = self._path(f"{self.root}/{name}/_versions/new-{uuid.uuid4().hex}")
        out = self._fs.create(new)
        out.write("\n".join(f[len(self.root) + 1 :] for f in folders).encode())
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(new, self._path(f"{self.root}/{name}/_versions/{number:08d}"), options)
        except Py4JJavaError as e:
            self._fs.delete(new, False)
            if e.java_exception.getClass().getSimpleName() != "FileAlreadyExistsException":
                raise
            raise WriteConflict(f"{name} got its version {number} from another writer") from e

    def init(self) -> dict[str, int]:
        """Empty tables where there are none, and the version of their schema; says how many rows each has."""
        for name in TABLES:
            if not self.versions(name):
                self.replace(name, self.spark.createDataFrame([], schema(name)))
        self.spark.range(1).select(F.lit(SCHEMA_VERSION).alias("schema_version")).write.mode("overwrite").parquet(f"{self.root}/_schema")
        return {name: self.scan(name).count() for name in TABLES}

    def shaped(self, name: str, rows: DataFrame) -> DataFrame:
        """`rows` with the table's columns, in its order and types; missing ones are null, others are left out."""
        return rows.select(*[(F.col(f"`{f.name}`") if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema(name)])

    def _write(self, name: str, rows: DataFrame) -> str:
        """Write `rows` to a new folder; returns it."""
        path, by = f"{self.root}/{name}/{uuid.uuid4().hex}", PARTITIONED.get(name)
        writer = self.shaped(name, rows).write.mode("errorifexists")
        (writer.partitionBy(by) if by else writer).parquet(path)
        return path

    def replace(self, name: str, rows: DataFrame) -> None:
        """A new version of the table that holds `rows`; refused if another writer makes one meanwhile."""
        after = self.versions(name)
        self._commit(name, after, [self._write(name, rows)])

    def append(self, name: str, rows: DataFrame) -> None:
        """A new version with `rows` added to those of the current one, whatever others write meanwhile; a second run of the same
        rows is the caller's to prevent (natural ids, upsert)."""
        folder = self._write(name, rows)
        while True:
            after = self.versions(name)
            try:
                return self._commit(name, after, [*(self.folders(after[-1]) if after else []), folder])
            except WriteConflict:
                continue

    def vacuum(self) -> None:
        """Delete all but the current versions, and what failed writes left; for times when nobody writes."""
        for name in TABLES:
            held = self.versions(name)
            if not held:
                continue
            keep = {self._path(p).getName() for p in [held[-1], *self.folders(held[-1])]} | {"_versions"}
            for folder in (f"{self.root}/{name}/_versions", f"{self.root}/{name}"):
                for status in self._fs.listStatus(self._path(folder)):
                    if status.getPath().getName() not in keep:
                        self._fs.delete(status.getPath(), True)

    def scan(self, name: str, *predicates: Column, **equal) -> DataFrame:
        """The rows for which all predicates hold; both reach the Parquet scan, and a vertical picks its folder."""
        held = self.versions(name)
        if not held:
            return self.spark.createDataFrame([], schema(name))
        read = self.spark.read.schema(schema(name))
        folders = self.folders(held[-1])
        # folders of partitions are told apart below one root only
        sides = [read.parquet(f) for f in folders] if name in PARTITIONED else [read.parquet(*folders)]
        rows = functools.reduce(DataFrame.unionByName, [side.select(*schema(name).names) for side in sides])
        for cond in (*predicates, *[F.col(c).eqNullSafe(F.lit(x)) if x is None else F.col(c) == F.lit(x) for c, x in equal.items()]):
            rows = rows.filter(cond)
        return rows

    def get(self, name: str, key: str) -> dict | None:
        """The row of that id, or None."""
        rows = self.scan(name, id=key).limit(1).collect()
        return rows[0].asDict(recursive=True) if rows else None

    def require(self, name: str, key: str) -> dict:
        row = self.get(name, key)
        if row is None:
            raise KeyError(f"no {name} has the id {key!r}")
        return row


def evidence_for_vertical(store: Store, vertical: str, originals_only: bool = True) -> DataFrame:
    return store.scan("evidence_event", *([F.col("is_duplicate_of").isNull()] if originals_only else []), vertical=vertical)


def members(store: Store, cluster_id: str) -> DataFrame:
    """Evidence rows of a cluster in their order there; members whose row is gone are left out."""
    held = store.scan("cluster_member", cluster_id=cluster_id).select(F.col("evidence_id").alias("id"), "place")
    return held.join(store.scan("evidence_event"), "id").orderBy("place")


def runs_of(store: Store, vertical: str) -> DataFrame:
    """Collection runs of a vertical's queries."""
    queries = store.scan("query", vertical=vertical).select(F.col("id").alias("query_id"), "vertical")
    return store.scan("source_run").join(queries, "query_id")


def claims_of(store: Store, vertical: str) -> DataFrame:
    rows = store.scan("evidence_event", vertical=vertical).select(F.col("id").alias("evidence_id"), "vertical")
    return store.scan("pain_claim").join(rows, "evidence_id")


def ideas_by(store: Store, vertical: str | None = None, band: str | None = None, most: int = 30) -> DataFrame:
    """The best ideas, of a vertical or band where one is given: a list of that length."""
    equal = {k: x for k, x in (("vertical", vertical), ("band", band)) if x is not None}
    return store.scan("product_idea", **equal).orderBy(F.col("score_total").desc(), "id").limit(most)


def embedding_mode(rows: DataFrame) -> str:
    """`stored` if any original has a vector, else `none`."""
    row = rows.filter("is_duplicate_of IS NULL").agg(F.bool_or(F.coalesce(F.size("embedding") > 0, F.lit(False))).alias("any")).first()
    return "stored" if row["any"] else "none"
