"""State of a stream as versions of a table, one per micro-batch.

Batch N reads the last version before N and writes version N. A batch that is run again
after a failure reads the same version and writes the same rows over its own, so
the state is exactly-once whatever was written before the failure. Everything is a
DataFrame: a hot key is summed by partial aggregation before it moves.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


class VersionedState:
    """Table versions ``v=N`` under ``folder``, which the stream's checkpoint belongs to."""

    def __init__(self, spark: SparkSession, folder: str, schema: str):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), T._parse_datatype_string(schema)
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)

    def _fs(self):
        return self._hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Numbers of the whole versions, upwards."""
        fs, jvm = self._fs(), self.spark.sparkContext._jvm
        if not fs.exists(self._hadoop):
            return []
        found = [re.fullmatch(r"v=(\d+)", s.getPath().getName()) for s in fs.listStatus(self._hadoop)]
        return sorted(int(m.group(1)) for m in found if m and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{m.group()}/_SUCCESS")))

    def before(self, batch: int | None = None) -> DataFrame:
        """The last version before ``batch`` (the last of all if None); empty if there is none."""
        known = [v for v in self.versions() if batch is None or v < batch]
        if not known:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/v={known[-1]}")

    def write(self, rows: DataFrame, batch: int) -> None:
        """Version ``batch``; versions that no replay can ask for any more are deleted."""
        old = [v for v in self.versions() if v < batch]
        rows.select(*self.schema.names).write.mode("overwrite").parquet(f"{self.folder}/v={batch}")
        for v in old[:-1]:
            self._fs().delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/v={v}"), True)
