"""URL filters: rules first, then gradient-boosted trees on lexical features.

Native: DataFrame expressions and MLlib only.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path:
then up to ``?``, ``#`` or the end. A rule (host, path, verdict) fits its host and all
subdomains if the path starts with the rule's; the longest rule wins, its verdict stands.

The other urls are judged by boosted trees. Labelled urls are those that a rule decides
(or a given ``label`` column: 1 blocks). Features: lengths, depth, labels of the host,
digit ratio, character entropy, parameter counts, marks, and the statistics of the suffix
(last host label): its smoothed block rate and its count among all other labelled urls, so a
label is no feature of itself. Fit: at
most ``max_train`` labelled rows, the smallest hashes (a bounded sample); statistics and
verdicts cover all rows.

Cases: a null url or one without ``://`` has empty host and path, fits no rule and is
judged by the trees. Repeated rows are judged alike. With no labelled url, or labels of
one kind, the verdict is ``allow``, or that kind. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearth.llm.common import prepare
from hearth.session import materialize

RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"),
         ("com", "/de/", "block"))
MAX_TRAIN = 20_000
TREES = 20
DEPTH = 4
SEED = 17
SMOOTH = 20.0
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

FEATURES = ("url_length", "host_length", "path_length", "query_length", "depth", "host_labels", "digit_ratio", "host_digit_ratio",
            "entropy", "host_entropy", "n_params", "n_hyphens", "has_fragment", "is_https", "has_extension", "suffix_rate", "suffix_count")


def parts(url: Column) -> dict[str, Column]:
    """host, path and query of a url."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return {"host": F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), ALPHABET, ALPHABET.lower()),
            "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), "query": F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1)}


def decide(rules: tuple[tuple[str, str, str], ...]) -> tuple[Column, Column]:
    """(rule, verdict) of a host and path; null where no rule fits."""
    rule = verdict = F.lit(None).cast("string")
    # the longest is asked first, so it is built last
    for host, path, said in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit(path))
        rule, verdict = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def entropy(text: Column) -> Column:
    """Bits a character; 0 for an empty text."""
    n = F.length(text).cast("double")
    counts = F.transform(F.array_distinct(F.split(text, "")), lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n)
    bits = F.aggregate(F.filter(counts, lambda p: p > 0), F.lit(0.0), lambda s, p: s - p * F.log2(p))
    return F.when(n > 0, bits).otherwise(0.0)


def _ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(part / F.nullif(whole, F.lit(0)), F.lit(0.0))


def lexical(pages: DataFrame, rules=RULES) -> DataFrame:
    """``pages(page_id, url[, label])`` with host, path, rule, the rule's verdict and lexical features."""
    given = ["label"] if "label" in pages.columns else []
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), *given).withColumns(parts(F.coalesce("url", F.lit(""))))
    rule, verdict = decide(rules)
    digits = lambda c: F.regexp_count(c, F.lit("[0-9]"))
    marks = lambda c, m: F.regexp_count(c, F.lit(m)).cast("double")
    url, host, path, query = (F.col(c) for c in ("url", "host", "path", "query"))
    return rows.withColumns({
        "rule": rule, "ruled": verdict, "suffix": F.regexp_extract(host, r"[^.]*$", 0),
        "url_length": F.length(url).cast("double"), "host_length": F.length(host).cast("double"),
        "path_length": F.length(path).cast("double"), "query_length": F.length(query).cast("double"),
        "depth": marks(path, "/[^/]"), "host_labels": marks(host, "[.]"), "digit_ratio": _ratio(digits(url), F.length(url)),
        "host_digit_ratio": _ratio(digits(host), F.length(host)), "entropy": entropy(url), "host_entropy": entropy(host),
        "n_params": marks(query, "[^&]+"), "n_hyphens": marks(host, "-"), "has_fragment": F.contains(url, F.lit("#")).cast("double"),
        "is_https": F.startswith(url, F.lit("https:")).cast("double"), "has_extension": F.rlike(path, F.lit("[.][a-z0-9]{1,5}$")).cast("double"),
    }).drop("query")


def judge(pages: DataFrame, rules=RULES, max_train: int = MAX_TRAIN, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """page_id, host, path, rule, verdict, and the trees' block probability."""
    prepare(pages.sparkSession)
    rows = lexical(pages, rules)
    label = F.col("label").cast("double") if "label" in pages.columns else F.when(F.col("ruled") == "block", 1.0).when(F.col("ruled") == "allow", 0.0)
    rows = rows.withColumn("y", label)
    labelled = rows.where("y is not null")
    # a row per suffix, summed before any shuffle
    stats = materialize(labelled.groupBy("suffix").agg(F.sum("y").alias("bad"), F.count("*").cast("double").alias("n")), "suffixes")
    total = stats.agg(F.sum("bad"), F.sum("n")).first()
    bad, n = total[0] or 0.0, total[1] or 0.0
    prior = bad / n if n else 0.0
    if not 0 < bad < n:  # nothing to tell apart
        only = F.lit("block" if n and bad == n else "allow")
        return rows.select("page_id", "host", "path", "rule", F.coalesce("ruled", only).alias("verdict"), F.lit(prior).alias("block_score"))

    def whole(part: DataFrame, own: bool = False) -> DataFrame:
        """With the suffix's statistics; a row to train on (``own``) is not counted in its own."""
        y, one = (F.col("y"), 1.0) if own else (F.lit(0.0), 0.0)
        rate = (F.col("bad") - y + SMOOTH * prior) / (F.col("n") - one + SMOOTH)
        return (part.join(stats, "suffix", "left").withColumn("suffix_rate", F.coalesce(rate, F.lit(prior)))
                .withColumn("suffix_count", F.coalesce(F.log1p(F.col("n") - one), F.lit(0.0))))

    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    sample = whole(labelled, own=True).select("y", *FEATURES, F.xxhash64("page_id", "url").alias("h"), "url").orderBy("h", "url", "y").limit(max_train)
    sample = materialize(sample.select("y", *FEATURES), "labelled")
    model = GBTClassifier(labelCol="y", featuresCol="features", maxIter=trees, maxDepth=depth, seed=SEED, stepSize=0.2).fit(assembler.transform(sample))
    scored = model.transform(assembler.transform(whole(rows))).withColumn("block_score", vector_to_array("probability")[1])
    verdict = F.coalesce("ruled", F.when(F.col("block_score") >= 0.5, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "block_score")


def op6(spark: SparkSession, pages: DataFrame) -> DataFrame:
    prepare(spark)
    return judge(pages.select("page_id", "url"))
