"""Output that grows batch by batch and survives a stop at any point.

A batch is a folder of Parquet files named by (run, chunk); when it is whole, one manifest row is
written for it.  Readers take listed batches only, so a batch whose job was stopped before its
manifest does not exist for them, and the same work done again gives every row once.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = "run string, chunk int, folder string, n long"


class Ledger:
    """Rows of one schema under a path that all executors share."""

    def __init__(self, spark: SparkSession, path: str, schema: str | T.StructType) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.schema = spark.createDataFrame([], schema).schema

    def _exists(self, folder: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def manifest(self) -> DataFrame:
        """(run, chunk, folder, n) of the batches that are whole; the first entry of a (run, chunk) counts."""
        if not self._exists(f"{self.path}/manifest"):
            return self.spark.createDataFrame([], MANIFEST)
        rows = self.spark.read.schema(MANIFEST).json(f"{self.path}/manifest")
        return rows.groupBy("run", "chunk").agg(F.min(F.struct("folder", "n")).alias("e")).select("run", "chunk", "e.folder", "e.n")

    def rows(self) -> DataFrame:
        """The rows of all listed batches."""
        folders = [r.folder for r in self.manifest().select("folder").collect()]  # a name for each batch
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/{f}" for f in folders])

    def has(self, run: str, chunk: int) -> bool:
        return not self.manifest().filter((F.col("run") == run) & (F.col("chunk") == chunk)).isEmpty()

    def append(self, df: DataFrame, run: str, chunk: int) -> int:
        """Writes a batch and lists it; returns its number of rows.  A batch that is listed already is left as it is."""
        if self.has(run, chunk):
            return 0
        n = self._data(df, folder := f"{run}-{chunk}")
        self._list(run, chunk, folder, n)
        return n

    def _data(self, df: DataFrame, folder: str) -> int:
        where = f"{self.path}/data/{folder}"
        df.select(*self.schema.names).write.mode("overwrite").parquet(where)  # what an earlier, stopped attempt left is not listed and goes
        return self.spark.read.schema(self.schema).parquet(where).count()

    def _list(self, run: str, chunk: int, folder: str, n: int) -> None:
        self.spark.createDataFrame([(run, chunk, folder, n)], MANIFEST).coalesce(1).write.mode("append").json(f"{self.path}/manifest")

    def pending(self, jobs: DataFrame, keys: list[str]) -> DataFrame:
        """Jobs whose keys no listed row has."""
        return jobs.join(self.rows().select(*keys).distinct(), keys, "left_anti")

    def describe(self) -> str:
        return json.dumps([r.asDict() for r in self.manifest().orderBy("run", "chunk").collect()])
