import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from hearth.llm import filter_audit, spelling, token_counts

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["Ça va? naïve CAFÉ Straße ΑΣ ΣΑΣ İI ıi ǅ ﬁ ½ ² Ⅷ 1٣4", "é à", "x​y﻿z w v　u\x85t   a",
       "don't DON'T we'RE 'S ''s 'sab o'clock's it'll'd", "a_b  __init__   $$$ ###!!! ... —–… €100\t\t x\n\n\ny \n z", "<|endoftext|>a <|endoftext|> <|endoftext|b|>",
       "<|endoftext|>", " <|endoftext|>  ", "\x00\x01\x1c \x1fa\x7fb\x1d\x1e", "日本語 テキスト 한국어 עברית हिन्दी <|endoftext|> ру́сский", "×÷ªº µ ĳ ŉ ſ ƀ Ǆǆ ɏ ȿ ǀǁ ʰ",
       "퟿ \U0001f469‍\U0001f52c", " ", "   ", "\n", "a ", "z" * 5000, "9 " * 60_000, "͸ ᲀ \U0001e030"]

# --- token counts --------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_lengths_equal_the_library(library, whole):
    split = token_counts.Splitter(PATH)
    texts = [r.text for r in whole.select("text").collect()] + ODD
    for table in ({}, {"the": 1, " the": 1, "<|": 2}):
        lengths = token_counts.Lengths(table, split, {}, 40)
        assert [lengths.count(t) for t in texts] == [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]
        assert len(lengths.cache) <= 40


def test_random_texts_split_as_the_library_does(library):
    rng = random.Random(5)
    signs = "  \n\t'slltre$.,09ab\x85\xa0\x1cÀéª²½×" + "日م "
    split = token_counts.Splitter(PATH)
    lengths = token_counts.Lengths({}, split, {}, 1000)
    for _ in range(1500):
        t = "".join(rng.choice(signs[:rng.choice((26, len(signs)))]) for _ in range(rng.randint(0, 25)))
        assert lengths.count(t) == len(library.encode(t, add_special_tokens=False).ids), repr(t)


def test_counts_of_a_table(spark, library, whole):
    odd = spark.createDataFrame([(10_000 + k, t, "en", "s", 1) for k, t in enumerate(ODD)], whole.schema)
    rows = whole.unionByName(odd).repartition(40)  # two levels of merging
    want = Counter()
    for r in rows.select("doc_id", "text").collect():
        n = len(library.encode(r.text or "", add_special_tokens=False).ids)
        want[(r.doc_id, len((r.text or "").encode()), n, n > 512)] += 1
    assert Counter(map(tuple, token_counts.op11(spark, rows).collect())) == want
    assert Counter(map(tuple, token_counts.count(rows, PATH, most=10, cache=20).collect())) == want


def test_count_of_no_rows_and_clashing_names(spark, empty, edge):
    assert token_counts.op11(spark, empty).count() == 0
    clash = edge.withColumn("n_bytes", F.lit("x")).withColumn("part", F.lit(1)).withColumn("n_tokens", F.lit(None).cast("int"))
    got = token_counts.op11(spark, clash)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"] and got.count() == edge.count()


def test_summaries_keep_what_is_frequent(spark):
    texts = [" ".join(["alpha"] * 30 + ["beta"] * 20 + [f"x{rng}q{k}" for k in range(40)]) for rng in range(60)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(33)
    table = token_counts.unpack(token_counts.frequent(docs, PATH, most=60))
    assert {" alpha", " beta"} <= set(table) and len(table) <= 60
    assert all(n == token_counts.Splitter(PATH).length(p) for p, n in table.items())
    assert token_counts.unpack(token_counts.pack({})) == {}
    counts = {f"k{i}": i for i in range(1, 50)}
    short = token_counts.shorten(counts, 9)
    assert len(short) <= 9 and all(counts[k] - 41 <= n <= counts[k] for k, n in short.items())


# --- filter audit ------------------------------------------------------------------------


def brute_features(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return [len(words), len(set(words)), len(re.findall("[A-Z]", text)), len(text), len(re.findall("[#$%&*|]", text))]


def as_batch(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def test_transducer_counts(whole):
    texts = [r.text or "" for r in whole.select("text").collect()] + ODD + ["", "a", "", "b b", "b", " ", "x" * 200 + " " + "x" * 200, "x" * 64 + " " + "x" * 65]
    data, offsets = as_batch(texts)
    got = filter_audit.measure(data, offsets)
    for i, t in enumerate(texts):
        assert [int(v[i]) for v in got.values()] == brute_features(t), t[:60]


@pytest.mark.parametrize("piece", [1, 2, 3, 7, 64])
def test_state_is_carried_from_piece_to_piece(piece):
    rng = random.Random(piece)
    texts = ["".join(rng.choice("ab \nÀ日#Z") for _ in range(rng.randint(0, 12))) for _ in range(80)]
    data, offsets = as_batch(texts)
    a, b = filter_audit.transduce(data, offsets, piece), filter_audit.transduce(data, offsets, 1 << 20)
    assert all(np.array_equal(a[k], b[k]) for k in a)
    words = [data[s:e].tobytes().decode() for s, e in zip(a[filter_audit.BEGIN], a[filter_audit.END])]
    assert words == [w for t in texts for w in re.findall(r"[^\x20\x09-\x0D]+", t)]


def test_hash_table_verifies_words(monkeypatch):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["ab", "ba", "abcdefgh", "abcdefgi", "abcdefghi", "q" * 70, "q" * 69 + "r"]) for _ in range(40)) for _ in range(5)]
    data, offsets = as_batch(texts)
    monkeypatch.setattr(filter_audit.Spans, "hashes", lambda self: np.full(len(self.start), 3, np.uint64))  # all words collide
    assert filter_audit.measure(data, offsets)["n_distinct"].tolist() == [len(set(t.split())) for t in texts]


def brute_audit(docs, labels):
    good = {r.doc_id for r in labels if r.quality == 1 and r.doc_id is not None}
    toxic = {r.doc_id for r in labels if r.toxic == 1 and r.doc_id is not None}
    lowest = {}
    for r in docs:
        if r.doc_id is not None:
            t = r.text or ""
            lowest[t] = min(lowest.get(t, r.doc_id), r.doc_id)
    parts = defaultdict(list)
    for r in docs:
        t = r.text or ""
        n, distinct, caps, points, signs = brute_features(t)
        fails = {c for c, f in zip("ABCDE", (n < 50, 100 * distinct < 65 * n, 100 * caps > 5 * points, signs > 0, r.doc_id is not None and r.doc_id > lowest[t])) if f}
        parts[r.source or ""].append((fails, r.doc_id in good, r.doc_id in toxic))
    out = {}
    for part, rows in parts.items():
        totals = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = rows
            for step, c in enumerate(order, 1):
                gone = [r for r in left if c in r[0]]
                left = [r for r in left if c not in r[0]]
                totals[c] += len(gone)
                all_fail = sum(c in r[0] for r in rows)
                out[part, order, step] = [len(left), len(gone), all_fail - len(gone), sum(r[0] == {c} for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone)]
        for key in [k for k in out if k[0] == part]:
            out[key].append(totals[key[1][key[2] - 1]])
    return out


def test_audit_against_brute_force(spark, whole, labels):
    marks = labels.withColumn("doc_id", F.col("doc_id") + 1000)
    marks = marks.unionByName(spark.createDataFrame([(1, 1, 0), (1, 0, 1), (2, 1, 1), (None, 1, 1), (7, 0, 1), (14, None, None)], marks.schema)).withColumn("part", F.lit("p"))
    got = filter_audit.op12(spark, whole.withColumn("digest", F.lit(1)), marks).collect()
    want = brute_audit(whole.collect(), marks.collect())
    assert {(r.part, r.filter_order, r.step): list(r[3:]) for r in got} == want and len(got) == len(want)
    assert {r.part for r in got} >= {"", "s1"}


def test_audit_against_sql(spark, whole, labels):
    rows = whole.where("doc_id IS NOT NULL")
    con = duckdb.connect()
    con.register("documents", rows.toPandas())
    con.register("labels", labels.toPandas())
    want = Counter(con.execute(filter_audit.ORACLE).fetchall())
    assert Counter(map(tuple, filter_audit.op12(spark, rows, labels).collect())) == want


def test_audit_of_no_rows(spark, empty, labels, edge):
    assert filter_audit.op12(spark, empty, labels).count() == 0
    assert filter_audit.op12(spark, edge, labels.limit(0)).where("good_lost > 0 OR toxic_lost > 0").count() == 0


# --- spelling variants ---------------------------------------------------------------------


def brute_words(rows):
    n = Counter()
    for r in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", r.text or ""):
            w = re.sub("[A-Z]", lambda m: m.group().lower(), w)
            h = zlib.crc32(f"{'' if r.doc_id is None else r.doc_id}:{w}".encode())
            if h % 31 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            n[w] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(n):
    """Near words by the words that one edit makes, over the letters that occur."""
    letters = sorted(set("".join(n)))
    out = {}
    for w in n:
        made = {w[:i] + c + w[i + 1:] for i in range(len(w)) for c in letters} | {w[:i] + w[i + 1:] for i in range(len(w))}
        made |= {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
        near = [x for x in made if x != w and x in n]
        form = min(near, key=lambda x: (-n[x], x), default=None)
        out[w] = (form if form is not None and n[form] >= 10 * n[w] else None, len(near))
    rows = set()
    for w, (form, k) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.add((w, form, root, n[w], k, n[form] if form else None))
    return rows


def test_variants_against_brute_force(spark, whole):
    n = brute_words(whole.collect())
    assert len(n) > 500
    got = spelling.op13(spark, whole)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = got.collect()
    assert set(map(tuple, rows)) == brute_variants(n) and len(rows) == len(n)
    assert any(r.form for r in rows)


@pytest.mark.parametrize("group", [1, 2, 7, 400])
def test_crowded_words_at_every_group_size(spark, group):
    rng = random.Random(group)
    n = {}
    for _ in range(700):
        w = "".join(rng.choice("ab") for _ in range(rng.randint(7, 9))) + rng.choice(["", "", "é", "日"])
        n[w] = 10 ** rng.randint(0, 6)
    n |= {"a" * 40: 5, "a" * 41: 60, "a" * 42: 700, "a" * 300: 1, "a" * 299 + "b": 20}
    vocabulary = spark.createDataFrame(list(n.items()), "word string, n long")
    got = spelling.group_variants(vocabulary, group=group).collect()
    assert set(map(tuple, got)) == brute_variants(n) and len(got) == len(n)
    check = rng.sample(sorted(n), 60)
    near = {r.word: r.n_near for r in got}
    assert all(near[w] == sum(one_edit(w, x) for x in n) for w in check)


def test_blocks_of_a_large_group():
    """A group of over a block's rows is compared block pair by block pair."""
    inside = sorted({"".join(random.Random(k).choice("abcdefghijkl") for _ in range(4)) for k in range(2600)})
    longer = sorted({x[:2] + "z" + x[2:] for x in inside[::2]})
    rows = inside + longer
    k = len(rows)
    tiles = spelling.Tiles(np.zeros(k, int), np.full(k, 8), np.full(k, 4), np.full(k, 8), rows).run()
    for i in range(0, len(inside), 97):
        near = [j for j, x in enumerate(inside) if one_edit(inside[i], x)]
        assert tiles.near[0, i] == len(near) and tiles.best[0, i] == (near[0] if near else -1)
        assert tiles.near[1, i] == sum(one_edit(inside[i], x) for x in longer)


def test_roots_of_a_long_chain(spark):
    links = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(37)] + [("x", "w5")], "word string, form string")
    got = {r.word: r.root for r in spelling.roots(links).collect()}
    assert got == {f"w{i}": "w37" for i in range(37)} | {"x": "w37"}


def test_variants_of_no_rows_and_clashing_names(spark, empty, edge):
    assert spelling.op13(spark, empty).count() == 0
    clash = edge.withColumn("word", F.lit("w")).withColumn("n", F.lit(1)).withColumn("form", F.lit(None).cast("string"))
    assert {tuple(r) for r in spelling.op13(spark, clash).collect()} == brute_variants(brute_words(edge.collect()))
