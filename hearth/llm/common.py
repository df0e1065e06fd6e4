"""Helpers that the training-data operators share: whole-table Arrow maps, table
reads, and a row key that does not trust ``doc_id``."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import hearth
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from hearth.session import checkpoint_root, configure

#: Rows of one Arrow batch. Documents average some KB, so a batch stays at a few MB
#: beside the longest single document.
BATCH_ROWS = 1000


#: Applications whose executors have this package's code.
_SHIPPED: set[str] = set()


def open_folder(uri: str):
    """(file system, path) of a shared folder by its URI scheme (Hadoop's names for S3 are
    Arrow's s3); a plain path is a mounted folder."""
    from pyarrow import fs

    scheme, found, rest = uri.partition(":")
    if not found or scheme.startswith("/"):
        return fs.FileSystem.from_uri(f"file://{uri}")
    return fs.FileSystem.from_uri(f"{'s3' if scheme in ('s3a', 's3n') else scheme}:{rest}")


def ship(spark: SparkSession) -> None:
    """Gives the executors this package, once per application: a zip in the shared folder,
    added with ``addPyFile``. Tasks then import it wherever their workers start."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    packed = io.BytesIO()
    root = Path(hearth.__file__).parent
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    name = f"hearth_code_{uuid.uuid4().hex[:12]}.zip"
    folder = checkpoint_root(spark).rstrip("/")
    fs, base = open_folder(folder)
    fs.create_dir(base, recursive=True)
    with fs.open_output_stream(f"{base}/{name}") as out:
        out.write(packed.getvalue())
    sc.addPyFile(f"{folder}/{name}")
    _SHIPPED.add(sc.applicationId)


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings of every operator here: UTC, AQE, small Arrow batches; and the
    package's code on the executors."""
    configure(spark)
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table as it is now (no listing is kept between calls)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def schema_of(ddl: str | T.StructType) -> T.StructType:
    return ddl if isinstance(ddl, T.StructType) else T._parse_datatype_string(ddl)


def map_batches(df: DataFrame, make: Callable[[], Callable[[dict[str, list]], dict[str, list]]], ddl: str) -> DataFrame:
    """Row-parallel Python over whole partitions: ``make()`` runs once per task and
    returns a function from one batch's columns (lists) to the output columns."""
    schema = schema_of(ddl)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict(step(batch.to_pydict()), schema=arrow)

    return df.mapInArrow(run, schema)


def stream_batches(df: DataFrame, run: Callable[[Iterable[dict[str, list]]], Iterable[dict[str, list]]], ddl: str) -> DataFrame:
    """As ``map_batches`` for a function over the task's whole stream of batches."""
    schema = schema_of(ddl)
    arrow = to_arrow_schema(schema)

    def outer(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in run(b.to_pydict() for b in batches if b.num_rows):
            yield pa.RecordBatch.from_pydict(out, schema=arrow)

    return df.mapInArrow(outer, schema)


def utf8(text: str | None) -> bytes:
    """UTF-8 of a text; null is empty."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def row_hash(*names: str) -> Column:
    """A 64-bit key of a row's content, beside its ``doc_id`` (ids may be null or repeat)."""
    return F.xxhash64(*[F.col(n) for n in names])


def null_safe(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> Column:
    """Join condition that lets null equal null; still an equi-join for Spark."""
    cond = None
    for a, b in pairs:
        c = left[a].eqNullSafe(right[b])
        cond = c if cond is None else cond & c
    return cond


def free_name(df: DataFrame, wish: str) -> str:
    """A column name that ``df`` has not got."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish
