"""Connected components of a link table, by alternating large-star and small-star
passes (joins and minimum aggregations only; logarithmically many rounds)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearth.session import materialize

MAX_ROUNDS = 60


def _min_neighbour(edges: DataFrame) -> DataFrame:
    return edges.groupBy("a").agg(F.min("b").alias("m"))


def _state(edges: DataFrame) -> tuple[int, int | None]:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return row.n, row.x


def components(edges: DataFrame) -> DataFrame:
    """``edges(a long, b long)`` -> ``(node long, root long)`` for every node that has a
    link, root being the smallest node of its component (root rows included).

    Loops (a = b) link nothing and give no row. Each round is written to the shared
    folder, so lineage stays one round long; only a count and a checksum reach the
    driver. A node with very many links is one key of a join: both sides of it come
    from exchanges that adaptive skew handling can split.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = _state(now)
    for _ in range(MAX_ROUNDS):
        if not state[0]:
            break
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = _min_neighbour(both).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = _min_neighbour(large)
        linked = large.join(low, "a")
        small = linked.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).distinct()
        now = materialize(small, "links")
        was, state = state, _state(now)
        if state == was:
            break
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
