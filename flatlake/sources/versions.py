"""Versions of a snapshot: data is written aside, and one row of a log makes it the current version."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "version long, batch_id long, data string, rows long"


class Snapshots:
    """A folder with a log of commits (JSON, a file each, which a file system makes visible at once) and the data of each
    version. A write that dies leaves data that no row of the log names, and the version before stays current. A batch that
    was committed already isn't written again; batch ids may skip. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def log(self) -> DataFrame:
        """version, batch_id, data, rows: a row for each commit."""
        try:
            return self.spark.read.schema(LOG).json(f"{self.path}/log")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], LOG)

    def current(self):
        """The last commit's row, or None."""
        return self.log().orderBy(F.desc("version")).first()

    def read(self, schema: str, version: int | None = None) -> DataFrame:
        """The rows of a version, else of the current one; none before the first commit."""
        found = self.current() if version is None else self.log().filter(F.col("version") == version).first()
        if found is None and version is not None:
            raise ValueError(f"there is no version {version}")
        return self.spark.createDataFrame([], schema) if found is None else self.spark.read.schema(schema).parquet(f"{self.path}/{found['data']}")

    def commit(self, rows: DataFrame, batch_id: int | None = None) -> int:
        """Writes rows as the next version; returns its number, or that of the version that has this batch or a later one."""
        last = self.current()
        if last is not None and batch_id is not None and last["batch_id"] is not None and last["batch_id"] >= batch_id:
            return last["version"]
        data, version = f"v={batch_id}" if batch_id is not None else f"data-{uuid.uuid4().hex}", 1 if last is None else last["version"] + 1
        rows.write.mode("overwrite").parquet(f"{self.path}/{data}")  # over what a batch that died has left, if anything
        n = self.spark.read.parquet(f"{self.path}/{data}").count()
        self.spark.createDataFrame([(version, batch_id, data, n)], LOG).coalesce(1).write.mode("append").json(f"{self.path}/log")
        return version
