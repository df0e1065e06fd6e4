"""Mixing sources to target weights by hash-threshold histograms.

Sizes are words. Every source gets a target (``targets``); a source whose target is
q times its size plus a rest is taken q times whole, and the rest is met by documents
whose hash lies under a threshold. The threshold is found without sorting: words are
summed by source and hash bucket (12 bits at a time), the bucket in which the running
sum crosses the rest is the boundary, and only rows of boundary buckets are summed
again by their next 12 bits, until a boundary holds one row. That row is taken if this
brings the source nearer to its target, so a source misses it by at most half of one
document. Thresholds are nested: a larger budget takes a superset.

Targets are a water level: a source gets weight x level, at most ``most`` times its size. A
source is capped if ``most`` x size / weight is under the level, so the level follows from sums over
the sources in the order of that ratio. Ranks and sums run over range partitions, and the plan is a
table with a row per source: any number of sources can be mixed, none of them on the driver.

Hash: XXH64 of (doc_id, source, text), then, for identical rows only, of the row's place
in the table; which of several identical rows is taken changes nothing in the result. The
hashes are written once, and thresholds and rows read them there.

Cases: a null text has size 0 (its row stays in the report, taken 0); null is a source of
its own, last; a source of size 0 has target 0. Repeated rows count as often as they
occur. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hearth.llm.common import prepare
from hearth.operators.order_stats import prefix_counts
from hearth.session import materialize

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEATS = 3
SPOTS = 8
LEVEL_BITS = 12
HASH_BITS = 60
#: The hash and, behind it, the hash of the row's place.
LEVELS = 2 * HASH_BITS // LEVEL_BITS

WORDS = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)).cast("long"), F.lit(0).cast("long"))


def weighted(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """``sizes(source, n)`` with weight: ``weights`` in turn over the sources by code point, null last."""
    placed = prefix_counts(sizes.where("source IS NOT NULL"), [], ["source"]).select("source", "n", F.col("_before").alias("place"))
    known = sizes.where("source IS NOT NULL").agg(F.count("*")).scalar()
    placed = placed.unionByName(sizes.where("source IS NULL").select("source", "n", known.alias("place")))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("place", F.lit(len(weights))) + 1).cast("int"))
    return placed.select("source", "n", weight.alias("weight"))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MAX_REPEATS) -> DataFrame:
    """(source, n, target): the sources share the sum of all sizes by weight; none gets over ``most``
    times its size, and what is over is shared again by weight among the others."""
    sources = materialize(weighted(sizes, weights), "sources")
    ratio = F.lit(float(most)) * F.col("n") / F.col("weight")
    # sources of one ratio together; words and weights before each ratio
    steps = sources.groupBy(ratio.alias("ratio")).agg(F.sum("n").alias("words"), F.sum("weight").alias("weights"))
    steps = prefix_counts(steps, [], ["ratio"], "words").withColumnsRenamed({"_before": "words_before", "_total": "words_total"})
    steps = prefix_counts(steps, [], ["ratio"], "weights").withColumnsRenamed({"_before": "weights_before", "_total": "weights_total"})
    open_ = F.col("weights_total") - F.col("weights_before")
    capped = F.lit(float(most)) * F.col("words_before")
    # the first ratio at which sources up to it capped and the others at its level take all words
    reached = steps.where(capped + F.col("ratio") * open_ >= F.col("words_total"))
    first = reached.agg(F.min(F.struct("ratio", ((F.col("words_total") - capped) / open_).alias("level"))).alias("first")).first().first
    level = first.level if first else 0.0
    return sources.select("source", "n", F.least(F.lit(float(most)) * F.col("n"), F.col("weight") * F.lit(float(level))).alias("target"))


def _hash(level: int) -> Column:
    """The bits of the first ``level + 1`` levels, as (column, prefix) parts: the 12 bits of this level."""
    column = "h" if level < HASH_BITS // LEVEL_BITS else "h2"
    shift = HASH_BITS - LEVEL_BITS * (level % (HASH_BITS // LEVEL_BITS) + 1)
    return F.shiftright(F.col(column), shift).bitwiseAND(F.lit((1 << LEVEL_BITS) - 1)).cast("int")


def _prefix(level: int) -> list[Column]:
    """Two longs that hold all bits of the levels before ``level``."""
    per = HASH_BITS // LEVEL_BITS
    first = min(level, per) * LEVEL_BITS
    second = max(0, level - per) * LEVEL_BITS
    return [F.shiftright(F.col("h"), HASH_BITS - first), F.shiftright(F.col("h2"), HASH_BITS - second)]


def with_hash(docs: DataFrame) -> DataFrame:
    """``docs`` with llm_size, h and h2 (60-bit, non-negative)."""
    sixty = lambda c: F.shiftrightunsigned(c, 64 - HASH_BITS)
    return (docs.withColumn("llm_size", size_of(F.col("text"))).withColumn("h", sixty(F.xxhash64("doc_id", "source", "text")))
            .withColumn("h2", sixty(F.xxhash64(F.monotonically_increasing_id(), F.lit("place")))))


def _here(prefix: list[Column], open_: DataFrame, rows: DataFrame) -> Column:
    return rows.source.eqNullSafe(open_.llm_source) & (prefix[0] == open_.p1) & (prefix[1] == open_.p2)


def thresholds(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MAX_REPEATS) -> DataFrame:
    """The mix's plan, one row per source, from ``rows(source, llm_size, h, h2)``: a row is
    taken ``whole`` times, and once more if its bits before ``level`` are under (p1, p2),
    or equal to them where ``edge`` holds."""
    sizes = materialize(rows.groupBy("source").agg(F.sum("llm_size").alias("n")), "source-sizes")
    whole = F.when(F.col("n") > 0, F.least(F.lit(int(most)), F.floor(F.col("target") / F.col("n") + 1e-9))).otherwise(0).cast("int")
    base = targets(sizes, weights, most).withColumn("whole", whole)
    base = materialize(base.select(F.col("source").alias("llm_source"), F.col("n").alias("source_size"), "target", "whole"), "targets")
    rest = F.col("target") - F.col("whole") * F.col("source_size")
    open_ = base.select("llm_source", F.lit(0).cast("long").alias("p1"), F.lit(0).cast("long").alias("p2"), rest.alias("need")).where((F.col("source_size") > 0) & (F.col("need") > 1e-6))
    done = None
    for level in range(LEVELS):
        inside = rows if not level else rows.join(open_.select("llm_source", "p1", "p2"), _here(_prefix(level), open_, rows), "left_semi")
        sums = inside.groupBy("source", _hash(level).alias("bucket")).agg(F.sum("llm_size").alias("n"), F.count("*").alias("rows"))
        sums = sums.join(open_, sums.source.eqNullSafe(open_.llm_source))
        # a window holds one source's buckets: 4096 rows at most
        upto = sums.withColumn("upto", F.sum("n").over(Window.partitionBy("llm_source").orderBy("bucket")))
        edge = upto.where(F.col("upto") >= F.col("need") - 1e-6).groupBy("llm_source", "p1", "p2", "need").agg(F.min_by(F.struct("bucket", "n", "rows", "upto"), "bucket").alias("e"))
        side = "p1" if level < HASH_BITS // LEVEL_BITS else "p2"
        edge = edge.withColumn(side, F.shiftleft(F.col(side), LEVEL_BITS).bitwiseOR(F.col("e.bucket").cast("long"))).withColumn("need", F.col("need") - F.col("e.upto") + F.col("e.n"))
        alone = (F.col("e.rows") == 1) | F.lit(level == LEVELS - 1)
        found = materialize(edge.select("llm_source", "p1", "p2", "need", alone.alias("last"), F.lit(level + 1).alias("level"), (2 * F.col("need") >= F.col("e.n")).alias("edge")), "open")
        ended = found.where("last").select("llm_source", "p1", "p2", "level", "edge")
        done = ended if done is None else done.unionByName(ended)
        open_ = found.where("NOT last").select("llm_source", "p1", "p2", "need")
        if open_.isEmpty():
            break
    none = {"p1": 0, "p2": 0, "level": 0}
    done = done.withColumnRenamed("llm_source", "done_source")
    plan = base.join(done, base.llm_source.eqNullSafe(done.done_source), "left").drop("done_source").fillna(none)
    return materialize(plan.withColumn("edge", F.coalesce("edge", F.lit(False))), "plan")


def take(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` with the plan's columns and llm_copies, how often the mix takes the row."""
    per, bits = HASH_BITS // LEVEL_BITS, LEVEL_BITS
    first = F.least(F.col("level"), F.lit(per)) * bits
    second = F.greatest(F.col("level") - per, F.lit(0)) * bits
    a = F.call_function("shiftright", F.col("h"), F.lit(HASH_BITS) - first)
    b = F.call_function("shiftright", F.col("h2"), F.lit(HASH_BITS) - second)
    under = (a < F.col("p1")) | ((a == F.col("p1")) & (b < F.col("p2")))
    at = (a == F.col("p1")) & (b == F.col("p2")) & F.col("edge")
    # the plan's size is known; where it is too large to be sent whole, a hot source is spread over its spots
    spots = plan.withColumn("llm_spot", F.explode(F.sequence(F.lit(0), F.lit(SPOTS - 1))))
    dealt = rows.withColumn("llm_at", F.pmod("h", F.lit(SPOTS)).cast("int"))
    joined = dealt.join(spots, dealt.source.eqNullSafe(spots.llm_source) & (dealt.llm_at == spots.llm_spot), "left").drop("llm_at", "llm_spot")
    return joined.withColumn("llm_copies", F.col("whole") + F.when((F.col("level") > 0) & (under | at), 1).otherwise(0))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MAX_REPEATS) -> DataFrame:
    """One row per document: its size, its source's size and target, and the words taken."""
    prepare(docs.sparkSession)
    rows = materialize(with_hash(docs.select("doc_id", "source", "text")).drop("text"), "sizes")
    out = take(rows, thresholds(rows, weights, most))
    return out.select("doc_id", F.col("llm_size").alias("size"), "source_size", "target", (F.col("llm_size") * F.col("llm_copies")).alias("taken"))


def apply_mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MAX_REPEATS) -> DataFrame:
    """The mixed table: every row as often as the mix takes it, all columns as they came. Rows
    are written once with their hashes, so both reads of them agree on every row's place."""
    prepare(docs.sparkSession)
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("llm_row"), "doc_id", "source", "text")
    rows = materialize(with_hash(held).select("llm_row", "source", "llm_size", "h", "h2"), "hashed")
    plan = thresholds(rows.select("source", "llm_size", "h", "h2"), weights, most)
    taken = take(rows.select("llm_row", "source", "h", "h2"), plan).where("llm_copies > 0")
    return taken.select("llm_row", F.explode(F.sequence(F.lit(1), F.col("llm_copies")))).select("llm_row.*")


def op9(spark: SparkSession, docs: DataFrame) -> DataFrame:
    prepare(spark)
    return mix(docs)
