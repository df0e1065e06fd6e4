"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprint: words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased, shingles
of ``k`` words joined by a space (fewer words: the whole sequence), XXH64 with seed 42
of each, repeats included; a bit is 1 if set in over half the hashes. No words: zero.

Candidates: radius r needs 2^(r+1) - 1 masks. Bit i gets a vector p(i) of r + 1 bits;
mask v (v <> 0) keeps the bits with <p(i), v> = 1 (mod 2). For any r bits there is a
v <> 0 orthogonal to their r vectors, so mask v hides all of them: two fingerprints
within r bits agree under that mask, and some table puts them into one bucket.
Nothing is lost and every candidate is checked by its exact bit distance.

Scale: tables hold distinct fingerprints, so a group of copies is one row before any
bucket is made. A bucket's links are found in blocks of one task and only a spanning
forest of them leaves it (at most size - 1 rows, never all pairs). A bucket above
``bucket_cap`` fingerprints is dealt out anew by the same construction on the bits its
key hides: pairs within the radius still meet, and every mask of a level keeps at least one
more bit while over ``radius`` are hidden (about half of them), so a bucket of distinct
fingerprints must get below the cap, or below the 2^radius that all lie within the radius.
Components are made by
joins (``graph.components``).

Cases: null and blank texts have fingerprint zero and are linked like any other. Null
ids are kept; a component's id is its smallest non-null id (null if it has none).
Repeated rows are copies of each other. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearth.llm.common import free_name, map_batches, null_safe, prepare, row_hash, stream_batches, utf8
from hearth.llm.graph import components
from hearth.session import materialize

SHINGLE_WORDS = 4
RADIUS = 4
BUCKET_CAP = 4096
SEED = 42
_STEP = 1 << 18  # shingles counted at once


def fingerprint(data: bytes, k: int = SHINGLE_WORDS) -> int:
    """Unsigned 64-bit SimHash of a UTF-8 text."""
    words = data.lower().split()
    if not words:
        return 0
    body = b" ".join(words)
    if len(words) <= k:
        return xxhash.xxh64_intdigest(body, SEED)  # one hash: its own majority
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    view, digest = memoryview(body), xxhash.xxh64_digest
    n = len(words) - k + 1
    ones = np.zeros(64, np.int64)
    lo, hi = starts[:n].tolist(), ends[k - 1:].tolist()
    for at in range(0, n, _STEP):
        block = b"".join([digest(view[s:e], SEED) for s, e in zip(lo[at:at + _STEP], hi[at:at + _STEP])])
        ones += np.unpackbits(np.frombuffer(block, np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


@cache
def _spread(radius: int) -> tuple[int, ...]:
    """All vectors of radius + 1 bits, such that the first n serve n positions: the units
    first, of which every v has one with <p, v> = 1, then those that evenest raise the
    number of positions that a v keeps."""
    size = 1 << (radius + 1)
    out = [1 << i for i in range(radius + 1)]
    kept = {v: v.bit_count() for v in range(1, size)}
    left = [p for p in range(size) if p not in out]
    while left:
        best = max(left, key=lambda p: sorted(k + ((p & v).bit_count() & 1) for v, k in kept.items()))
        left.remove(best)
        out.append(best)
        kept = {v: k + ((best & v).bit_count() & 1) for v, k in kept.items()}
    return tuple(out)


def covering_masks(radius: int, bits: list[int], seed: int) -> list[int]:
    """The 2^(radius+1) - 1 masks over the given bit positions. The vectors run through
    0 .. 2^(radius+1) - 1 in turn over a shuffled order of positions, so that each mask
    keeps about half of them; fewer positions than vectors take those of ``_spread``."""
    size = 1 << (radius + 1)
    vectors = range(size) if len(bits) >= size else _spread(radius)
    order = np.random.default_rng(seed).permutation(len(bits))
    masks = []
    for v in range(1, size):
        mask = 0
        for i, bit in enumerate(bits):
            if bin(vectors[int(order[i]) % size] & v).count("1") & 1:
                mask |= 1 << bit
        masks.append(mask)
    return masks


def sub_masks(mask: int, radius: int, level: int) -> list[int]:
    """Masks for the bucket of a key under ``mask``: the same construction on the bits
    that it hides, each joined with ``mask``."""
    hidden = [i for i in range(64) if not mask >> i & 1]
    return [mask | m for m in covering_masks(radius, hidden, SEED + level)]


def spanning_links(values: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """A spanning forest of the graph "within ``radius`` bits" on distinct values."""
    a: list[int] = []
    b: list[int] = []
    left = values
    while left.size > 1:
        todo, left = [left[0]], left[1:]
        while todo and left.size:
            x = todo.pop()
            near = np.bitwise_count(left ^ x) <= radius
            if near.any():
                found, left = left[near], left[~near]
                a.extend([int(x)] * found.size)
                b.extend(found.tolist())
                todo.extend(found)
    return a, b


def _scan_buckets(radius: int, cap: int, level: int):
    """Reads rows (mask, key, fp) in the order of (mask, key); gives links, and for buckets
    above ``cap`` their rows under finer masks. Holds at most ``cap`` rows of a bucket."""
    cap = max(cap, 1 << radius)  # distinct values with at most ``radius`` hidden bits
    known: dict[int, list[int]] = {}

    def finer(mask: int, values: np.ndarray) -> Iterator[dict]:
        masks = known.setdefault(mask, sub_masks(mask & (1 << 64) - 1, radius, level))
        for m in masks:
            keys = (values & np.uint64(m)).view(np.int64).tolist()
            yield {"mask": [signed(m)] * len(keys), "key": keys, "a": values.view(np.int64).tolist(), "b": [None] * len(keys)}

    def links(a: list[int], b: list[int]) -> dict:
        return {"mask": [None] * len(a), "key": [None] * len(a), "a": [signed(x) for x in a], "b": [signed(x) for x in b]}

    def run(batches: Iterable[dict[str, list]]) -> Iterator[dict]:
        held, at, hot = np.zeros(0, np.uint64), None, False
        for cols in batches:
            mask, key = np.array(cols["mask"], np.int64), np.array(cols["key"], np.int64)
            fp = np.array(cols["fp"], np.int64).view(np.uint64)
            cut = np.flatnonzero((mask[1:] != mask[:-1]) | (key[1:] != key[:-1])) + 1
            bounds = np.concatenate(([0], cut, [len(fp)]))
            a: list[int] = []
            b: list[int] = []
            first, last = (int(mask[0]), int(key[0])), (int(mask[-1]), int(key[-1]))
            if at is not None and at != first:
                if not hot:
                    x, y = spanning_links(held, radius)
                    a += x
                    b += y
                held, hot = held[:0], False
            pairs = np.flatnonzero(np.diff(bounds) == 2)
            inner = pairs[(pairs > 0) & (pairs < len(bounds) - 2)]  # the outer groups may go on in other batches
            lo = bounds[inner]
            near = np.bitwise_count(fp[lo] ^ fp[lo + 1]) <= radius
            a += fp[lo[near]].tolist()
            b += fp[lo[near] + 1].tolist()
            done = set(inner.tolist())
            for g in np.flatnonzero((np.diff(bounds) > 1) | (np.arange(len(bounds) - 1) == 0) | (np.arange(len(bounds) - 1) == len(bounds) - 2)).tolist():
                if g in done:
                    continue
                values, ends = fp[bounds[g]:bounds[g + 1]], g == len(bounds) - 2
                if g == 0:
                    values = np.concatenate((held, values))
                    held = held[:0]
                if (g == 0 and hot) or values.size > cap:
                    hot = ends
                    yield from finer(int(mask[bounds[g]]), values)
                elif ends:
                    held, hot = values, False
                else:
                    x, y = spanning_links(values, radius)
                    a += x
                    b += y
                    hot = False
            at = last
            if a:
                yield links(a, b)
        if held.size > 1 and not hot:
            yield links(*spanning_links(held, radius))

    return run


def fingerprints(docs: DataFrame, k: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, h, fp): fp as a signed long; h tells texts apart when ids repeat."""

    def make():
        def step(cols):
            return {"doc_id": cols["doc_id"], "h": cols["h"], "fp": [signed(fingerprint(utf8(t), k)) for t in cols["text"]]}
        return step

    return map_batches(docs.select("doc_id", "text", row_hash("text").alias("h")), make, "doc_id long, h long, fp long")


def links(values: DataFrame, radius: int = RADIUS, bucket_cap: int = BUCKET_CAP) -> DataFrame:
    """(a, b): links that join the distinct fingerprints ``values(fp)`` into the same
    components as all pairs within ``radius`` bits do."""
    tables = F.array(*[F.lit(signed(m)) for m in covering_masks(radius, list(range(64)), SEED)])
    rows = values.select(F.explode(tables).alias("mask"), "fp").select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
    found = None
    for level in range(1, 64):
        dealt = rows.repartition("mask", "key").sortWithinPartitions("mask", "key", "fp")
        out = materialize(stream_batches(dealt, _scan_buckets(radius, bucket_cap, level), "mask long, key long, a long, b long"), "buckets")
        pairs = out.where("mask is null").select("a", "b")
        found = pairs if found is None else found.union(pairs)
        rows = out.where("mask is not null").select("mask", "key", F.col("a").alias("fp")).distinct()
        if rows.isEmpty():
            return found
    raise RuntimeError("buckets did not get below the cap")


def classes(docs: DataFrame, k: int = SHINGLE_WORDS, radius: int = RADIUS, bucket_cap: int = BUCKET_CAP) -> DataFrame:
    """(doc_id, h, fp, root, component_id), one row per row of ``docs``; root is the
    component's smallest fingerprint, component_id its smallest document id."""
    prepare(docs.sparkSession)
    prints = materialize(fingerprints(docs, k), "prints")
    groups = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "groups")
    roots = components(links(groups.select("fp"), radius, bucket_cap))
    rooted = groups.join(roots, groups.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    rooted = materialize(rooted, "rooted")
    # written apart: a component with very many fingerprints is then a key that the join can split
    lowest = materialize(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "lowest")
    named = rooted.select("fp", "root").join(lowest, "root").select("fp", "root", "component_id")
    return prints.join(named, "fp")


def keep_one(docs: DataFrame, k: int = SHINGLE_WORDS, radius: int = RADIUS, bucket_cap: int = BUCKET_CAP) -> DataFrame:
    """One row of each group, all columns as they came: the row with the smallest id
    (null ids last), then the smallest text hash; of rows alike in id and text the one whose
    columns, written as JSON, come first."""
    prepare(docs.sparkSession)
    rows = materialize(classes(docs, k, radius, bucket_cap).select("doc_id", "h", "root"), "classes")
    best = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "h")).alias("w"))
    best = best.select(F.col("w.doc_id").alias("llm_id"), F.col("w.h").alias("llm_h"), F.lit(True).alias("llm_best"))
    keys = rows.groupBy("doc_id", "h").agg(F.count("*").alias("n"))
    marked = materialize(keys.join(best, keys.doc_id.eqNullSafe(best.llm_id) & (keys.h == best.llm_h), "left")
                         .select("doc_id", "h", "n", F.col("llm_best").isNotNull().alias("best")), "marked")
    out = marked.where("not best or n > 1").select(F.col("doc_id").alias("llm_id"), F.col("h").alias("llm_h"))
    key = free_name(docs, "llm_text_hash")
    hashed = docs.withColumn(key, row_hash("text"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    on = lambda d, x: null_safe(d, x, [("doc_id", "llm_id"), (key, "llm_h")])
    single = hashed.join(out, on(hashed, out), "left_anti").select(*columns)
    again = marked.where("best and n > 1").select(F.col("doc_id").alias("llm_id"), F.col("h").alias("llm_h"))
    if again.isEmpty():
        return single
    whole = F.struct(*columns)
    repeated = (hashed.join(again, on(hashed, again), "left_semi").groupBy(F.col("doc_id").alias("llm_id"), F.col(key).alias("llm_h"))
                .agg(F.min_by(whole, F.to_json(whole, {"ignoreNullFields": "false"})).alias("llm_row")).select("llm_row.*"))
    return single.unionByName(repeated)


def op3(spark: SparkSession, docs: DataFrame) -> DataFrame:
    prepare(spark)
    return classes(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
