import hashlib
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import xxhash
from pyspark.sql import functions as F

from hearth.llm import graph, line_dedup, simhash


def brute_print(text, k=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    ones = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g, 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(grams))


def brute_roots(prints, radius):
    distinct = sorted(set(prints))
    parent = {p: p for p in distinct}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[i + 1:]:
            if (a ^ b).bit_count() <= radius:
                parent[root(b)] = root(a)
    return {p: root(p) for p in distinct}


def check(rows, radius=4):
    prints = [brute_print(r.text) for r in rows]
    roots = brute_roots(prints, radius)
    low = defaultdict(list)
    for r, p in zip(rows, prints):
        low[roots[p]].append(r.doc_id)
    low = {k: min((i for i in v if i is not None), default=None) for k, v in low.items()}
    return Counter((r.doc_id, f"{p:016x}", low[roots[p]]) for r, p in zip(rows, prints))


def test_matches_brute_force(spark, whole):
    want = check(whole.select("doc_id", "text").collect())
    assert Counter(map(tuple, simhash.op3(spark, whole).collect())) == want


def test_small_caps_lose_no_link(spark):
    rng = random.Random(7)
    values = [rng.getrandbits(64)]
    for _ in range(400):  # a dense group that chains within the radius, and strangers
        values.append(values[rng.randrange(len(values))] ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    values = sorted({*values, *(rng.getrandbits(64) for _ in range(100))})
    table = spark.createDataFrame([(simhash.signed(v),) for v in values], "fp long")
    want = brute_roots(values, 4)
    sizes = Counter(want.values())
    for cap in (4096, 16):
        roots = dict(map(tuple, graph.components(simhash.links(table, 4, cap)).collect()))
        got = Counter(roots.get(simhash.signed(v), simhash.signed(v)) for v in values)
        assert sorted(got.values()) == sorted(sizes.values())


def test_every_level_shrinks_a_bucket():
    rng = random.Random(2)
    for radius in (1, 2, 4):
        for n in range(radius + 1, 33):
            bits = rng.sample(range(64), n)
            masks = simhash.covering_masks(radius, bits, 42 + n)
            assert all(masks), (radius, n)
            for _ in range(50):
                hidden = sum(1 << b for b in rng.sample(bits, radius))
                assert any(not m & hidden for m in masks)


def test_a_bucket_in_few_bits(spark):
    """5000 values that agree in the 48 bits of a second-level mask are linked whole."""
    rng = random.Random(3)
    mask = simhash.sub_masks(simhash.covering_masks(4, list(range(64)), simhash.SEED)[0], 4, 1)[0]
    hidden = [b for b in range(64) if not mask >> b & 1]
    assert len(hidden) == 16
    base = rng.getrandbits(64) & mask
    values = sorted(base | sum(1 << b for k, b in enumerate(hidden) if x >> k & 1) for x in rng.sample(range(1 << 16), 5000))
    table = spark.createDataFrame([(simhash.signed(v),) for v in values], "fp long")
    roots = dict(map(tuple, graph.components(simhash.links(table)).collect()))
    assert len(simhash.spanning_links(np.array(values, np.uint64), 4)[0]) == 4999
    assert len({roots[simhash.signed(v)] for v in values}) == 1


def test_covering_masks_guarantee():
    rng = random.Random(1)
    for bits in (list(range(64)), [3, 9, 17, 20, 33, 40, 41, 59, 63]):
        masks = simhash.covering_masks(4, bits, 42)
        assert len(masks) == 31
        for _ in range(300):
            hidden = sum(1 << b for b in rng.sample(bits, 4))
            assert any(not m & hidden for m in masks)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 500), (700, 600)], "a long, b long")
    got = dict(map(tuple, graph.components(edges).collect()))
    assert got == {i: 0 for i in range(201)} | {600: 600, 700: 600}


def test_keep_one(edge, empty, whole):
    kept = simhash.keep_one(whole.withColumn("h", F.lit(1)))
    assert kept.columns == [*whole.columns, "h"]
    rows = whole.select("doc_id", "text").collect()
    prints = {(r.doc_id, r.text): brute_print(r.text) for r in rows}
    roots = brute_roots(list(prints.values()), 4)
    groups = Counter(roots[prints[(r.doc_id, r.text)]] for r in kept.collect())
    assert set(groups.values()) == {1} and set(groups) == set(roots.values())
    assert simhash.keep_one(empty).count() == 0 and simhash.keep_one(edge).columns == edge.columns


def brute_lines(rows):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    holders = defaultdict(set)
    low = lambda i: -(1 << 70) if i is None else i
    for r in rows:
        for x in (r.text or "").split("\n"):
            holders[key(x)].add(low(r.doc_id))
    lose = {k: max(v) for k, v in holders.items() if len(k) >= 40 and len(v) >= 5}
    out = Counter()
    for r in rows:
        lines = (r.text or "").split("\n")
        kept = [x for x in lines if not (key(x) in lose and lose[key(x)] != low(r.doc_id))]
        out[(r.doc_id, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())] += 1
    return out


def test_lines_match_brute_force(whole):
    want = brute_lines(whole.select("doc_id", "text").collect())
    assert Counter(map(tuple, line_dedup.digest(whole).collect())) == want
    # filters that are far too small let everything through to the exact count
    assert Counter(map(tuple, line_dedup.digest(whole, max_log2_bits=12).collect())) == want
    assert sum(n * k[2] for k, n in want.items()) > 0


def test_lines_match_sql(docs):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM read_parquet('/root/testdata/sf0.001/documents.parquet')")
    assert sorted(map(tuple, line_dedup.digest(docs).collect())) == sorted(con.execute(line_dedup.ORACLE).fetchall())


def test_filters_never_miss_a_repeat():
    rng = np.random.default_rng(2)
    f = line_dedup.TwoFilters(1 << 14)
    first, second = rng.integers(0, 1 << 63, 500, np.uint64), rng.integers(0, 1 << 63, 500, np.uint64)
    f.add(first)
    f.add(np.concatenate([second, first[:100]]))
    assert line_dedup.holds(f.twice, line_dedup.probes(first[:100], f.bits)).all()
    assert line_dedup.holds(f.once, line_dedup.probes(second, f.bits)).all()
    assert line_dedup.holds(f.twice, line_dedup.probes(second, f.bits)).mean() < 0.2


def test_folded_filters_follow_the_repeats(spark):
    rng = np.random.default_rng(3)
    hashes = rng.integers(0, 1 << 64, 400_000, np.uint64, endpoint=False)
    often, seldom = hashes[:2000], hashes[2000:]
    rows = spark.createDataFrame([(int(h) - (1 << 63),) for h in np.concatenate([seldom, often, often])], "h long").repartition(7)
    packed = line_dedup.packed_hashes(rows, lambda cols: (np.array(cols["h"], np.int64).astype(np.uint64) + np.uint64(1 << 63)))
    assert packed.agg(F.sum("n")).first()[0] <= 404_000
    filters = line_dedup.seen_twice(packed)
    assert filters.holds(often).all()
    assert filters.holds(seldom).mean() < 0.1
    # sized by what was seen twice, not by all lines
    assert 8 * len(filters.packed) < len(hashes) * line_dedup.BITS_PER_LINE / 4
    # folded to a limit, a filter lets more through and misses nothing
    small = line_dedup.seen_twice(packed, max_log2_bits=12)
    assert len(small.packed) <= len(filters.packed) and small.holds(often).all()


def test_lines_of_rows_without_ids_and_repeated_ids(spark):
    line = ["a line of some forty code points, number %d, is here" % i for i in range(6)]
    rows = [(None, "\n".join(line[:3] + ["own %d" % i])) for i in range(40)]
    rows += [(7, "\n".join(line)), (7, "\n".join(line)), (7, line[0])] + [(i, line[0] + "\n" + line[i]) for i in range(5)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute_lines(table.collect())
    assert Counter(map(tuple, line_dedup.digest(table).collect())) == want
    assert all(k[2] == 1 for k in want if k[0] is None)


def test_texts_that_lose_no_line_do_not_move(spark, whole):
    branches = line_dedup.digest(whole)._jdf.queryExecution().optimizedPlan().children()
    assert "Join" not in branches.apply(0).toString() and "Join" in branches.apply(1).toString()


def test_lines_empty_and_text(empty, edge):
    assert line_dedup.digest(empty).count() == 0
    texts = {r.doc_id: r.text for r in line_dedup.dedup(edge).collect()}
    assert texts[13] == "x" and texts[3] == "" and texts[15].startswith("This passage")
