import hashlib
import io
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from hearth.llm import decontaminate, mixing, token_files

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_encoder_equals_the_library(library, whole):
    texts = [r.text or "" for r in whole.select("text").collect()]
    texts += ["Ça va? naïve CAFÉ Straße ΑΣ ΣΑΣ İI ıi ǅ ﬁ ½ ² Ⅷ 1٣4", "e\u0301 a\u0300 o\u0302\u0323", "x\u200by\ufeffz\u00a0w\u2003v\u3000u\x85t",
              "don't DON'T we'RE 'S ''s 'sab o'clock's", "a_b __init__ $$$ ###!!! ... —–… €100 100€", "<|startoftext|> <| x |> a<|endoftext|>b",
              "\x00\x01\x1f a\x7fb", "日本語 テキスト 한국어 עברית हिन्दी", "×÷ªº µ ĳ ŉ ſ ƀ Ǆǆ ɏ ȿ", "\ud7ff\ue000 \U0001f469\u200d\U0001f52c"]
    enc = token_files.Encoder(PATH, memo_words=50)
    assert enc.chunked and enc.width == 2
    for t in texts:
        assert np.frombuffer(enc.encode(t), "<u2").tolist() == library.encode(t, add_special_tokens=False).ids, t[:80]


def test_memo_is_bounded_by_entries_and_by_length(library):
    enc = token_files.Encoder(PATH, memo_words=100)
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 5))) for _ in range(3000)]
    long = ["日本" * 5000, "q" * 70_000, "a1b2" * 9000, "word" * 40 + ","]
    for _ in range(2):
        for text in (" ".join(words), "the common word; " * 500, *long):
            assert np.frombuffer(enc.encode(text), "<u2").tolist() == library.encode(text, add_special_tokens=False).ids
            assert len(enc.chunks) <= 50 and len(enc.chunks.older) <= 50
            assert all(len(w) <= token_files.MEMO_LENGTH for w in (*enc.chunks, *enc.chunks.older))


def test_memo_keeps_what_is_used_again():
    made = []
    memo = token_files.Memo(lambda w: made.append(w) or w.encode(), 10)
    for k in range(100):
        assert memo["often"] == b"often" and memo[str(k)] == str(k).encode()
    assert made.count("often") == 1 and len(made) == 101


def test_round_trip_of_a_table(library, whole):
    rows = whole.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()
    rows.sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.h))
    start, want = 0, Counter()
    for r in rows:
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 2]
        want[(r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] += 1
        start += len(ids)
    got = Counter(map(tuple, token_files.read(token_files.write(whole, PATH, shards=3, frame_bytes=4096)).collect()))
    if got != want:  # rows of one id may trade places between equal hashes only
        assert got == want


class Mem(io.BytesIO):
    def __init__(self, data):
        super().__init__(data)
        self.asked = 0

    def size(self):
        return len(self.getbuffer())

    def read(self, n=-1):
        self.asked += n
        return super().read(n)


def shard(ids, frame_bytes=64):
    out = io.BytesIO()
    w = token_files.ShardWriter(out, 2, frame_bytes)
    for i, x in ids:
        w.add(i, np.array(x, "<u2").tobytes())
    w.close()
    return out.getvalue()


def test_reader_opens_only_the_frames_asked_for():
    docs = [(i, [i, i + 1, 7] * (i % 9)) for i in range(200)] + [(None, []), (5, [1])]
    data = shard(docs)
    file = Mem(data)
    r = token_files.ShardReader(file)
    assert len(r.frames) > 20 and [r.doc_id(i) for i in range(len(docs))] == [i for i, _ in docs]
    before = file.asked
    assert r.ids(77).tolist() == docs[77][1] and r.find(5) == [5, 201]
    assert file.asked - before == r.frames[r.docs[77, 1]][0]
    assert all(r.ids(i).tolist() == x for i, (_, x) in enumerate(docs))


def test_damage_is_found():
    data = bytearray(shard([(1, list(range(500)))]))
    data[12] ^= 1
    with pytest.raises(ValueError):
        token_files.ShardReader(Mem(bytes(data))).ids(0)
    with pytest.raises(ValueError):
        token_files.ShardReader(Mem(bytes(data[:-1])))


def test_frames_are_plain_zstandard():
    import zstandard

    data = shard([(1, [5] * 10), (2, [6] * 40), (3, [8])])
    got = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
    assert np.frombuffer(got, "<u2").tolist() == [5] * 10 + [6] * 40 + [8]


def test_empty_table(empty):
    assert token_files.op5(empty.sparkSession, empty).count() == 0


def brute_fill(sizes):
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    low, high = 0.0, 1e12  # the water level: sum of min(3 size, level * weight) is the sum of sizes
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(3 * sizes[s], mid * w[s]) for s in order) < sum(sizes.values()) else (low, mid)
    return {s: min(3 * sizes[s], low * w[s]) for s in order}


def filled(spark, sizes):
    rows = spark.createDataFrame(list(sizes.items()), "source string, n long")
    return {r.source: r.target for r in mixing.targets(rows).collect()}


def test_water_fill(spark):
    for sizes in ({"a": 10, "b": 100, None: 50}, {"a": 1, "b": 1, "c": 1000}, {"x": 0, "y": 7}, {"z": 5}, {"a": 3, "b": 0, None: 0}, {"a": 0, None: 0},
                  {f"s{i}": (i * 7919) % 101 for i in range(60)}):
        got, want = filled(spark, sizes), brute_fill(sizes)
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 * (1 + want[s]) for s in sizes)
    assert filled(spark, {}) == {}


def test_a_million_sources(spark):
    rows = spark.range(1_000_000).select(F.concat(F.lit("host"), F.col("id").cast("string")).alias("source"), (F.pmod(F.xxhash64("id"), F.lit(900)) * F.when(F.col("id") % 1000 == 0, 5000).otherwise(1)).alias("n"))
    got = mixing.targets(rows).toPandas()
    order = got.sort_values("source").reset_index(drop=True)
    w = np.array([5.0, 2.0, 1.0])[np.arange(len(order)) % 3]
    n = order.n.to_numpy(float)
    low, high = 0.0, 1e12
    for _ in range(120):
        mid = (low + high) / 2
        low, high = (mid, high) if np.minimum(3 * n, mid * w).sum() < n.sum() else (low, mid)
    assert np.allclose(order.target, np.minimum(3 * n, low * w), rtol=1e-9, atol=1e-6) and abs(order.target.sum() / n.sum() - 1) < 1e-9


def test_taken_rows_do_not_depend_on_how_the_table_is_cut(spark, tmp_path):
    rows = [(i % 40, "word " * (i % 9 + 1), f"s{i % 4}") for i in range(400)] * 2  # identical rows
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).write.parquet(str(tmp_path / "t"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    seen = []
    try:
        for size in ("134217728", "1500"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            docs = spark.read.parquet(str(tmp_path / "t"))
            seen.append((Counter(map(tuple, mixing.mix(docs).collect())), Counter(map(tuple, mixing.apply_mix(docs).collect()))))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sum(g[4] * k for g, k in seen[0][0].items()) == sum(len(r[1].split()) * k for r, k in seen[0][1].items())
    assert seen[0] == seen[1]


def check_mix(rows, got):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sums, largest, taken = Counter(), Counter(), Counter()
    for r in rows:
        sums[r.source] += size(r.text)
        largest[r.source] = max(largest[r.source], size(r.text))
    target = brute_fill({r.source: sums[r.source] for r in rows})
    source = {r.doc_id: r.source for r in rows}
    assert Counter((g.doc_id, g.size) for g in got) == Counter((r.doc_id, size(r.text)) for r in rows)
    for g in got:
        s = source[g.doc_id]
        assert g.source_size == sums[s] and abs(g.target - target[s]) < 1e-6 * (1 + target[s])
        assert g.taken in (0, g.size, 2 * g.size, 3 * g.size)
        taken[s] += g.taken
    for s in sums:
        assert abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6


def test_mix(whole):
    rows = whole.where("doc_id is not null").collect()
    seen = Counter((r.doc_id) for r in rows)
    rows = [r for r in rows if seen[r.doc_id] == 1]
    one = whole.where(F.col("doc_id").isin([r.doc_id for r in rows]))
    got = mixing.mix(one).collect()
    check_mix(rows, got)
    again = mixing.mix(one.repartition(7)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_mix_of_identical_rows(spark):
    """A boundary inside a run of identical rows is found by the rows' places."""
    rows = [(1, "five words are in here", "a")] * 300 + [(2, "one", "b")] * 20
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = mixing.mix(docs).collect()
    for s, n in ((1, 5), (2, 1)):
        own = [g for g in got if g.doc_id == s]
        assert abs(sum(g.taken for g in own) - own[0].target) <= n / 2 + 1e-9


def test_mix_applied(whole, empty, edge):
    want = Counter()
    for g in mixing.mix(whole).collect():
        want[g.doc_id] += g.taken // g.size if g.size else 0
    out = mixing.apply_mix(whole)
    assert out.columns == whole.columns
    got = Counter()
    for r in out.collect():
        got[r.doc_id] += bool((r.text or "").strip(" \t\n\x0b\x0c\r"))
    assert +got == +want
    assert mixing.mix(empty).count() == 0 and mixing.apply_mix(empty).count() == 0
    assert mixing.apply_mix(edge).columns == edge.columns


LOW = {c: c + 32 for c in range(65, 91)}


def dwords(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def brute_contamination(rows, items, size=13):
    windows = defaultdict(set)
    for i in items:
        w = dwords(i.text)
        for a in range(max(1, len(w) - size + 1) if w else 0):
            windows[tuple(w[a:a + size])].add("" if i.item_id is None else str(i.item_id))
    out = Counter()
    for r in rows:
        w, hit, ids = dwords(r.text), set(), set()
        for n in {len(k) for k in windows}:
            for a in range(len(w) - n + 1):
                if tuple(w[a:a + n]) in windows:
                    ids |= windows[tuple(w[a:a + n])]
                    hit.update(range(a, a + n))
        out[(r.doc_id, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))] += 1
    return out


@pytest.fixture(scope="module")
def items(spark, bench):
    extra = spark.createDataFrame([(9001, "seven wizards"), (9001, "seven wizards"), (9002, None), (9003, " .. "), (None, "emoji"), (9004, "a a a"),
                                   (9005, "word3 and3 word4 and4"), (9006, "Émile àé")], "item_id long, text string")
    return bench.unionByName(extra)


def test_contamination_matches_brute_force(whole, items, monkeypatch):
    whole = whole.where(F.length("text").isNull() | (F.length("text") < 100_000))
    want = brute_contamination(whole.collect(), items.collect())
    cols = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    got = decontaminate.report(decontaminate.build_index(whole, block_tokens=5000), items).select(*cols).collect()
    assert Counter(map(tuple, got)) == want and any(g.contaminated for g in got)
    monkeypatch.setattr(decontaminate, "ITEM_BLOCK_BYTES", 10_000)  # several query blocks, merged per row
    got = decontaminate.report(decontaminate.build_index(whole), items).select(*cols).collect()
    assert Counter(map(tuple, got)) == want
    kept = decontaminate.remove_contaminated(whole, items)
    assert kept.columns == whole.columns
    assert Counter(r.doc_id for r in kept.collect()) == sum((Counter({k[0]: n}) for k, n in want.items() if not k[5]), Counter())


def test_items_stay_off_the_driver(spark, whole, items, monkeypatch):
    """Items of any number and length go to the tasks in bounded blocks, not through the driver."""
    whole = whole.where(F.length("text").isNull() | (F.length("text") < 100_000))
    long = whole.where("doc_id = 1000").select(F.lit(9100).cast("long").alias("item_id"), "text")
    items = items.select("item_id", "text").unionByName(long)
    want = brute_contamination(whole.collect(), items.collect())
    texts = {r.text for r in items.where("text is not null").collect()}
    local = type(items).toLocalIterator

    def checked(frame, *args, **kwargs):
        for row in local(frame, *args, **kwargs):
            assert not texts & set(row)
            yield row

    monkeypatch.setattr(type(items), "toLocalIterator", checked)
    monkeypatch.setattr(decontaminate, "ITEM_BLOCK_WINDOWS", 1500, raising=False)
    got = decontaminate.report(decontaminate.build_index(whole), items)
    cols = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert Counter(map(tuple, got.select(*cols).collect())) == want
    monkeypatch.setattr(decontaminate, "ITEM_BLOCK_WINDOWS", 7)  # items are cut as well
    path = decontaminate.write_items(items)
    written = spark.read.parquet(path)
    assert written.groupBy("block").agg(F.sum("n_windows").alias("n")).agg(F.max("n")).first()[0] <= 7
    windows = lambda rows: {(i, w) for i, t in rows for w in decontaminate.windows_of(t)}
    assert windows((r.item, bytes(r.words).split()) for r in written.collect()) == \
        windows((None if r.item_id is None else str(r.item_id), [w.encode() for w in dwords(r.text)]) for r in items.collect())


def near_ids(text, items, slop):
    """Items of which some window has a place where each term is at most ``slop`` off."""
    w, out = dwords(text), set()
    for i in items:
        t = dwords(i.text)
        for a in range(max(1, len(t) - 12) if t else 0):
            win = t[a:a + 13]
            if any(all(x in w[max(0, p + j - slop):max(0, p + j + slop + 1)] for j, x in enumerate(win)) for p in range(-slop, len(w) + slop)):
                out.add(i.item_id)
    return out


def test_null_and_empty_item_ids_are_two_items(spark):
    items = spark.createDataFrame([(None, "one two three"), ("", "one two three four"), (None, "nowhere else"), ("b", "one two")], "item_id string, text string")
    docs = spark.createDataFrame([(1, "zero one two three four"), (2, "one two three"), (3, "none")], "doc_id long, text string")
    got = {r.doc_id: (r.n_items, r.items_sha256) for r in decontaminate.op8(spark, docs, items).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got == {1: (3, sha(",b")), 2: (2, sha("b")), 3: (0, sha(""))}
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    con.register("benchmark", items.toPandas())
    assert {r[0]: (r[3], r[4]) for r in con.execute(decontaminate.ORACLE).fetchall()} == got


def test_windows_are_kept_by_one_term_each():
    rng = random.Random(4)
    wanted = {tuple(rng.choice([b"a", b"b", b"c", b"rare%d" % k]) for _ in range(4)): {k} for k in range(200)}
    kept = decontaminate.by_anchor(wanted)
    assert sorted((w, ids) for ws in kept.values() for w, ids in ws) == sorted(wanted.items())
    assert all(anchor in w for anchor, ws in kept.items() for w, _ in ws)


def test_shards_follow_the_input(spark, tmp_path, monkeypatch):
    spark.range(20_000).select("id", F.repeat(F.sha2(F.col("id").cast("string"), 256), 4).alias("text")).write.parquet(str(tmp_path / "t"))
    docs = spark.read.parquet(str(tmp_path / "t"))
    assert token_files.shards_for(docs) == 4  # the session's shuffle partitions
    monkeypatch.setattr(token_files, "SHARD_BYTES", 50_000)
    assert token_files.shards_for(docs) > 8


def test_proximity(spark):
    rng = random.Random(5)
    texts = ["alpha beta gamma delta", "alpha x beta y gamma delta", "delta gamma beta alpha", "alpha", "delta x x x alpha beta gamma"]
    texts += [" ".join(rng.choice("alpha beta gamma delta x y".split()) for _ in range(rng.randrange(12))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "beta alpha"), (3, "gamma x delta y beta")], "item_id long, text string")
    asked = items.collect()
    for slop in (1, 2):
        for r in decontaminate.report(decontaminate.build_index(docs), items, slop=slop).collect():
            exact = near_ids(texts[r.doc_id], asked, 0)
            assert (r.n_items, r.n_near_items) == (len(exact), len(near_ids(texts[r.doc_id], asked, slop) - exact)), texts[r.doc_id]


def test_a_registered_query_gives_proximity(spark, tmp_path):
    """Words put in inside every window leave an item near by; the exact columns stay op8's."""
    from __spark_entry__ import queries

    item = [f"term{i}" for i in range(26)]
    gaps = [w + (" also" if i % 6 == 5 else "") for i, w in enumerate(item)]
    texts = [" ".join(item), " ".join(gaps), "nothing of it", None, " ".join(gaps[:14])]
    items = [(1, " ".join(item)), (2, " ".join(item[:12])), (3, "elsewhere")]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    near = queries()["op8_proximity"](spark, str(tmp_path))
    exact = queries()["op8_decontamination"](spark, str(tmp_path))
    assert Counter(map(tuple, near.drop("n_near_items", "near_items").collect())) == Counter(map(tuple, exact.collect()))
    asked = spark.createDataFrame(items, "item_id long, text string").collect()
    for r in near.collect():
        want = sorted(map(str, near_ids(texts[r.doc_id], asked, 2) - near_ids(texts[r.doc_id], asked, 0)))
        assert (r.n_near_items, r.near_items) == (len(want), want)
    assert {r.doc_id: r.near_items for r in near.collect()}[1] == ["1", "2"]


def test_contamination_matches_sql(docs, bench):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/sf0.001/{t}.parquet')")
    assert sorted(map(tuple, decontaminate.op8(docs.sparkSession, docs, bench).collect())) == sorted(con.execute(decontaminate.ORACLE).fetchall())


def test_contamination_of_long_text_and_empty_tables(spark, edge, empty, items):
    got = {r.doc_id: r for r in decontaminate.report(decontaminate.build_index(edge), items).collect()}
    assert got[6].n_words == 120_000 and got[6].n_hit > 0
    assert decontaminate.report(decontaminate.build_index(empty), items).count() == 0
    none = decontaminate.report(decontaminate.build_index(edge), items.limit(0)).collect()
    assert len(none) == edge.count() and not any(r.n_hit for r in none)
