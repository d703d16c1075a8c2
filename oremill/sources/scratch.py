"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Scratch:
    """Tables of one run below spark.checkpoint.dir, or, where that is unset and all run in one process, below a folder of our own."""

    def __init__(self, spark: SparkSession, name: str):
        named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        self.spark = spark
        self.root = f"{(named or tempfile.mkdtemp(prefix='oremill-')).rstrip('/')}/oremill/{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0

    def put(self, df: DataFrame) -> DataFrame:
        """Write `df` and read it back: a cut of the lineage that survives the loss of any executor."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        """Remove every table of the run, once nothing reads them any more."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def __enter__(self) -> "Scratch":
        return self

    def __exit__(self, kind, error, trace) -> None:
        self.clear()
