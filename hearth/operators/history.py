"""Run history (EVL-3, SRC-10): an append-only log of evaluation rows, keyed by run.

A run's rows lie in a folder of their own, so a run that is written again (a driver that
came back after its commit was lost) replaces its own rows and nobody else's, and runs that end at
the same time do not meet. A run counts once its folder is whole.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns of a log row beside the run.
METRICS = "target string, model string, n long, rmse double, mae double, r2 double"


class RunLog:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def commit(self, run: str, at: str, rows: DataFrame) -> None:
        """Writes the rows of a run (``METRICS``, and any others) that ended at ``at`` (yyyy-MM-dd HH:mm:ss)."""
        if not re.fullmatch(r"[\w.-]+", run):
            raise ValueError(f"a run's name must be letters, digits, '_', '.' and '-': {run!r}")
        known = T._parse_datatype_string(METRICS).fieldNames()
        extra = [c for c in rows.columns if c not in known]
        made = rows.select(F.lit(run).alias("run"), F.lit(at).cast("timestamp").alias("ended"), *known,
                           F.to_json(F.struct(*extra)).alias("params") if extra else F.lit(None).cast("string").alias("params"))
        made.write.mode("overwrite").parquet(f"{self.folder}/run={run}")

    def rows(self) -> DataFrame:
        """All rows of all whole runs."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        root = jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = root.getFileSystem(conf)
        found = [str(s.getPath()) for s in fs.listStatus(root)] if fs.exists(root) else []
        whole = [p for p in found if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{p}/_SUCCESS"))]
        schema = T._parse_datatype_string(f"run string, ended timestamp, {METRICS}, params string")
        return self.spark.read.schema(schema).parquet(*whole) if whole else self.spark.createDataFrame([], schema)


def _first(rows: DataFrame, by: list[str], *order) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def latest_best(log: DataFrame) -> DataFrame:
    """Of each target, the best model (lowest RMSE, then by name) of the last run that holds it."""
    last = log.groupBy("target").agg(F.max(F.struct("ended", "run")).alias("last")).select(F.col("target").alias("_target"), "last.*")
    last = last.withColumnsRenamed({"ended": "_ended", "run": "_run"})
    own = log.join(last, (log.target == last._target) & (log.run == last._run) & (log.ended == last._ended)).select(*log.columns)
    return _first(own, ["target"], F.col("rmse").asc_nulls_last(), "model")


def changes(log: DataFrame) -> DataFrame:
    """Each target and model run by run: its RMSE, the one of its run before, and the best so far."""
    w = Window.partitionBy("target", "model").orderBy("ended", "run")
    return log.select("target", "model", "run", "ended", "rmse", F.lag("rmse").over(w).alias("rmse_before"),
                      F.min("rmse").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("best_so_far"))
