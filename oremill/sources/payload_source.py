"""Search payloads as a Spark data source: `spark.read.format("search_payloads")` over folders `source=NAME` of JSON lines.

The rights to collect are given to the source as an option, and it grants nothing without them: files of a source that may not
be collected are not listed, let alone opened.  Conditions on `source` choose folders and conditions on `query` choose lines
before rows are built.  Files are cut into ranges of SPLIT_BYTES, a partition each, so that a large file is read by many tasks.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from ..operators import policy as rights

NAME = "search_payloads"
SPLIT_BYTES = 32 << 20
BATCH = 1024
SCHEMA = "query string, source string, results array<struct<url:string,title:string,content:string,engines:array<string>,score:double,publishedDate:string>>, error string"
_RESULT = pa.struct([("url", pa.string()), ("title", pa.string()), ("content", pa.string()), ("engines", pa.list_(pa.string())), ("score", pa.float64()), ("publishedDate", pa.string())])
_ARROW = pa.schema([("query", pa.string()), ("source", pa.string()), ("results", pa.list_(_RESULT)), ("error", pa.string())])


@dataclass
class Range(InputPartition):
    """Lines of one file that begin in [start, stop)."""

    path: str
    source: str
    start: int
    stop: int


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def _text(x) -> str | None:
    return None if x is None else x if isinstance(x, str) else json.dumps(x)


def parsed(line: bytes, source: str) -> dict:
    """A payload row; a line that is no object of the expected form is a collection that failed."""
    try:
        held = json.loads(line)
        results = [
            {
                **{k: _text(r.get(k)) for k in ("url", "title", "content", "publishedDate")},
                "engines": [str(e) for e in r.get("engines") or []],
                "score": float(r["score"]) if isinstance(r.get("score"), (int, float)) else None,
            }
            for r in held.get("results") or []
        ]
        return {"query": _text(held.get("query")), "source": source, "results": results, "error": _text(held.get("error"))}
    except (ValueError, AttributeError, TypeError):
        return {"query": None, "source": source, "results": [], "error": "payload is not readable"}


class PayloadReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.allowed = set(json.loads(options.get("allowed", "[]")))
        self.split = int(options.get("split_bytes", SPLIT_BYTES))
        self.queries: set[str] | None = None

    def pushFilters(self, filters: list[Filter]):
        """Equality and membership on `source` and `query` are settled here; Spark applies the rest."""
        for f in filters:
            wanted = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if wanted is not None and f.attribute == ("source",):
                self.allowed &= wanted
            elif wanted is not None and f.attribute == ("query",):
                self.queries = wanted if self.queries is None else self.queries & wanted
            else:
                yield f

    def partitions(self) -> list[Range]:
        fs, root = opened(self.path)
        found = []
        for source in sorted(self.allowed):
            for info in fs.get_file_info(pafs.FileSelector(f"{root}/source={source}", allow_not_found=True, recursive=True)):
                if info.is_file and info.base_name[0] not in "._":
                    found += [Range(info.path, source, at, min(at + self.split, info.size)) for at in range(0, info.size, self.split)]
        return found or [Range("", "", 0, 0)]

    def lines(self, part: Range) -> Iterator[bytes]:
        fs, _ = opened(self.path)
        with io.BufferedReader(fs.open_input_file(part.path), 1 << 20) as f:
            at = part.start
            if at:
                f.seek(at - 1)  # a line that begins before the range belongs to the range before
                at += len(f.readline()) - 1
            while at < part.stop and (line := f.readline()):
                at += len(line)
                if line.strip():
                    yield line

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        rows = []
        for line in self.lines(partition) if partition.path else ():
            row = parsed(line, partition.source)
            if self.queries is None or row["query"] in self.queries:
                rows.append(row)
            if len(rows) == BATCH:
                yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)


class PayloadSource(DataSource):
    """Options: path; allowed, a JSON list of the sources that may be collected; split_bytes."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PayloadReader:
        return PayloadReader(dict(self.options))


def may_collect(policy: DataFrame) -> list[str]:
    """Sources that may be collected: a name a row of the registry."""
    asked = policy.select("source", F.lit("COLLECT").alias("purpose"))
    return sorted(r["source"] for r in rights.decisions(asked, policy).filter("allowed").collect())


def read_gated(spark: SparkSession, path: str, policy: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Payload rows of the sources that the policy lets be collected.

    Spark keeps what the last scan of a frame has pushed down for a scan that pushes nothing; a condition that always holds
    makes each scan push its own.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PayloadSource)
    return spark.read.format(NAME).option("allowed", json.dumps(may_collect(policy))).option("split_bytes", split_bytes).load(path).filter("source IS NOT NULL")


def folders(spark: SparkSession, path: str) -> list[str]:
    """Sources that have a folder of payloads, whatever their rights: the adapters of a replay."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()] if fs.exists(at) else []
    return sorted(n.split("=", 1)[1] for n in names if n.startswith("source="))
