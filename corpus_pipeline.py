"""The corpus pipeline: quality rules, SimHash near-dedup, benchmark decontamination,
mixing to target weights, token files. Each stage works on what its predecessor kept and
is written as Parquet and read again before the next one.

A stage is ``f(spark, docs, sf_dir) -> DataFrame``; all but the last return the columns of
``docs`` as they came. ``ORACLE_SQL`` is None: line labelling, XXH64 fingerprints, hash
thresholds and token ids are outside SQL; tests/llm holds the stages against brute force.

Cases: texts that are null, empty or without words fail the base rules and go in the first stage.
Ids may be null or repeat: rows are told apart by id and text, and of the rows of a group the
smallest id stays (null last), then the smallest text hash, then the first by all columns; equal
runs give equal rows. A null source is a source of its own. Columns beside those of the documents pass
through all stages but the last, whatever their names. Texts of any length are read whole. Empty
documents, labels or benchmarks give, in turn, no rows, the fixed line model, and no removal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hearth.llm import decontaminate, mixing, quality, simhash, token_files
from hearth.llm.common import prepare, table
from hearth.session import remove, scratch_path

ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the base rules or the line labelling reject."""
    prepare(spark)
    return quality.filter_documents(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each SimHash group (four-word shingles, four bits)."""
    prepare(spark)
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that benchmark windows cover by a twentieth or more."""
    prepare(spark)
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes every document as often as the mix of sources asks (repeats are rows)."""
    prepare(spark)
    return mixing.apply_mix(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes token files and returns, read back from them, a row per document."""
    return token_files.op5(spark, docs)


STAGES = [("quality rules", quality_rules), ("SimHash near-dedup", near_dedup), ("benchmark decontamination", decontamination),
          ("mixing sources", source_mix), ("token output", token_output)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written and read again in the shared folder; what a stage
    read goes once its own rows are written."""
    prepare(spark)
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        path = scratch_path(spark, f"stage{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
