"""Session helpers: build a local session for tests/bench, find the shared scratch folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from typing import Any

from pyspark.sql import SparkSession

#: Scratch paths made by this process and not deleted yet.
_WRITTEN: list[str] = []

# Runtime settings every job in this package relies on; applied without touching
# settings a cluster operator already chose (except the time zone, which the
# date arithmetic and the streaming casts assume is UTC).
_RUNTIME_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int = 8, app: str = "hearth") -> SparkSession:
    """Local session used by tests and bench.py (a cluster passes its own session)."""
    master = master or os.environ.get("HEARTH_MASTER", "local[8]")
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("HEARTH_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in _RUNTIME_DEFAULTS.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Idempotent runtime configuration for a session handed to us."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    for k, v in _RUNTIME_DEFAULTS.items():
        cur = spark.conf.get(k, None)
        if cur is None:
            spark.conf.set(k, v)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this is set by the operator and points at shared storage; we only
    read it, and it is an error if it is unset there: a folder of one machine would
    be seen by none of the others. Under a local master a local folder is created and set.
    """
    sc = spark.sparkContext
    root = sc.getCheckpointDir()
    if not root:
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root and not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError(f"spark.checkpoint.dir is unset and the master is {sc.master}: name a folder that all machines share")
        if not root:
            root = tempfile.mkdtemp(prefix="hearth-ckpt-")
        sc.setCheckpointDir(root)
        root = sc.getCheckpointDir() or root
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared checkpoint folder for a written table."""
    root = checkpoint_root(spark).rstrip("/")
    path = f"{root}/hearth-{name}-{uuid.uuid4().hex[:12]}"
    _WRITTEN.append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes one scratch path, by the file system of its scheme."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    if path in _WRITTEN:
        _WRITTEN.remove(path)


@contextmanager
def scratch(spark: SparkSession):
    """Deletes, at its end, every scratch path made inside: build a query's DataFrame and
    consume it within one such block, and shared storage does not grow with the jobs run."""
    before = set(_WRITTEN)
    try:
        yield
    finally:
        for path in [p for p in _WRITTEN if p not in before]:
            remove(spark, path)


def together(*jobs: Callable[[], Any], at_once: int = 4) -> list:
    """Runs jobs that do not need each other's results at the same time, from a few threads, and gives
    their results in order; while one table's last tasks run, the others' use the free cores. The
    first error is raised once all have ended."""
    with ThreadPoolExecutor(max_workers=min(at_once, max(1, len(jobs)))) as pool:
        return [f.result() for f in [pool.submit(job) for job in jobs]]


def materialize(df, name: str = "table"):
    """Write ``df`` as a Parquet table under the shared checkpoint folder and read
    it back: the lineage is cut (a lost executor re-reads files instead of
    recomputing), the plan of every later branch starts at a pruned columnar
    scan, and the data is computed once. (An eager ``DataFrame.checkpoint()``
    would run the plan twice: once to count, once to write the RDD.)

    Used where one intermediate feeds several branches of a plan (e.g. the rows
    and a rank or median table derived from them): column pruning makes those
    branches differ, so Spark would otherwise run the upstream scan and
    aggregation once per branch."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
