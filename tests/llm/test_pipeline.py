from collections import Counter

import corpus_pipeline
from hearth.llm import simhash, token_files

import __spark_entry__

SF001 = "/root/testdata/sf0.001"


def test_stages_on_the_small_tables(spark, tmp_path):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    columns = docs.columns
    counts = [docs.count()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF001)
        out.write.parquet(path := str(tmp_path / str(i)))
        docs = spark.read.parquet(path)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] > counts[3] > 0
    assert docs.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    stage2 = spark.read.parquet(str(tmp_path / "1"))
    assert simhash.op3(spark, stage2).select("component_id").distinct().count() == stage2.count()


GOOD = " ".join(f"{w}{k}" for k in range(12) for w in ("some", "plain", "words", "that", "read", "like", "prose", "in", "one", "line")) + "."


def awkward(spark, folder):
    """A folder of tables in which the awkward rows pass the first stage: nulls, ties, repeats, clashing names."""
    names = "doc_id long, text string, lang string, source string, n_chars long, llm_text_hash string, llm_key long, h long, `a.b` int, rows array<int>"
    rows = [(1, GOOD, "en", "s1", 1, "x", 7, 1, 1, [1]), (1, GOOD, "de", "s2", 1, "y", 7, 1, 2, [1]), (1, GOOD, None, "s0", 1, None, None, None, None, None),
            (None, GOOD + " more", "en", None, 1, "x", 7, 1, 1, [2]), (None, GOOD + " more", "en", None, 1, "x", 7, 1, 1, [2]), (2, None, "en", "s1", 1, "x", 7, 1, 1, None),
            (3, "", "en", "s1", 1, "x", 7, 1, 1, None)]
    rows += [(10 + k, " ".join(f"{w}{(k * 37 + i * i) % 1009}" for i, w in enumerate(GOOD.split())), "en", f"s{k % 3}", 1, "x", 7, k, 1, [k]) for k in range(20)]
    spark.createDataFrame(rows, names).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (None, 1, 1), (1, 0, 1), (12, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    items = [("i1", " ".join(GOOD.split()[:20])), (None, rows[8][1]), ("", None), ("i1", "")]
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows


def through(spark, folder, out):
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(folder)).write.parquet(path := f"{out}/{i}")
        docs = spark.read.parquet(path)
        seen.append(docs)
    return seen


def test_awkward_rows_through_all_stages_twice(spark, tmp_path):
    rows = awkward(spark, tmp_path / "in")
    first, second = (through(spark, tmp_path / "in", tmp_path / k) for k in "ab")
    for a, b in zip(first, second):
        assert a.columns == b.columns and Counter(str(r) for r in a.collect()) == Counter(str(r) for r in b.collect())
    columns = spark.read.parquet(str(tmp_path / "in/documents.parquet")).columns
    assert all(d.columns == columns for d in first[:-1])
    kept = first[0].collect()
    assert {r.doc_id for r in kept} == {r[0] for r in rows} - {2, 3}
    one = first[1].where("doc_id = 1 OR doc_id IS NULL").collect()
    assert [(r.doc_id, r.lang) for r in one] == [(1, "de")]  # first by its columns: "de" before "en" and null
    assert first[2].where("doc_id = 1").count() == 0  # holds the item
    assert first[4].count() == first[3].count() > 0


def test_empty_tables_through_all_stages(spark, tmp_path):
    awkward(spark, tmp_path / "in")
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/in/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert all(d.count() == 0 for d in through(spark, tmp_path / "none", tmp_path / "out"))


def test_run_and_registration(spark):
    names = set(__spark_entry__.queries())
    assert "pipeline" in names and {f"op{i}" for i in range(1, 14)} == {n.split("_")[0] for n in names if n.startswith("op") and n[2].isdigit()}
    assert corpus_pipeline.run(spark, SF001).count() > 0
    assert token_files.END_ID == 2
