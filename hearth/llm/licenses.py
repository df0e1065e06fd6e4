"""License scans by a positional rare-token index.

Native: DataFrame expressions only.

Index: of every text the positions of licence words (the words of the templates). Words
that are common in any prose (``COMMON``) are indexed where a licence word stands right
before them, so that phrases such as "cc by" are whole. The words' document frequencies in the
corpus give IDF.

Lookup: a template has to have its whole mandatory key phrase in the file, so the
key-phrase word that is rarest in the corpus (highest IDF) stands for it. A file is looked up by
those of its words that stand for a template, the rarest of its licence words, and each of
their places names one shift (text position minus template position) of that template. A word
that no file holds rules its template out. No candidate is dropped.

Match: at a named shift, the template's other words are looked for at their relative positions in
the file's postings. A template's share is the IDF of the words aligned there over the template's. It
gives its label if all words of its key phrase are aligned and the share is ``min_share`` or more.
Base phrases are templates that must be aligned whole; each shift is a place. Licences have several
templates: sentences of their notices, and their SPDX lines.

Words: A-Z lower-cased, runs of characters outside ASCII punctuation, blanks and controls.

Cases: a null text is empty: no words, no labels (empty strings), null places, score 0.
Repeated rows and null ids are answered row by row. Overlapping places all count. A corpus
without licence words gives no labels. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hearth.llm.common import prepare
from hearth.session import materialize

BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: (label, words of the notice, its mandatory key phrase).
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2"),
    ("gpl-2", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("gpl-3", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("lgpl", "licensed under the gnu lesser general public license version", "gnu lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license version", "gnu affero general public license"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "hereby granted free of charge"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
    ("cc-by-4.0", "licensed under cc by 4 0", "cc by 4"),
    ("cc0", "dedicated to the public domain under cc0 1 0 universal", "cc0 1 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee", "distribute this software"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies", "permission notice shall"),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products", "endorse or promote products"),
    ("isc", "provided that the above copyright notice and this permission notice appear in all copies", "permission notice appear"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "published by the free software foundation"),
    ("mpl-2.0", "if a copy of the mpl was not distributed with this file you can obtain one at", "copy of the mpl"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software released"),
)
#: Licences by their SPDX identifiers, as words of a line "SPDX-License-Identifier: ...".
SPDX = (("apache-2.0", "apache 2 0"), ("mit", "mit"), ("isc", "isc"), ("bsd-2-clause", "bsd 2 clause"), ("bsd-3-clause", "bsd 3 clause"), ("gpl-2", "gpl 2 0"),
        ("gpl-3", "gpl 3 0"), ("lgpl", "lgpl 2 1"), ("lgpl", "lgpl 3 0"), ("agpl", "agpl 3 0"), ("mpl-2.0", "mpl 2 0"), ("unlicense", "unlicense"), ("cc0", "cc0 1 0"))
TEMPLATES += tuple((label, f"spdx license identifier {words}", f"license identifier {words}") for label, words in SPDX)
COMMON = frozenset("a all an and any are as at be can by for from if in into is it its may name names not of on one or that the this to use used under was with without you 0 1 2 3 4 v".split())
MIN_SHARE = 0.5
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _key_positions(words: list[str], key: str) -> set[int]:
    k = key.split()
    at = next(i for i in range(len(words)) if words[i:i + len(k)] == k)
    return set(range(at, at + len(k)))


def _postings(spark: SparkSession, base, templates) -> DataFrame:
    """Postings of the templates, a few hundred rows that are written in this file:
    (template, label, is_base, word, at, is_key, n_key)."""
    rows = [(i, label, True, words.split(), set(range(len(words.split())))) for i, (words, label) in enumerate(base)]
    rows += [(len(base) + i, label, False, words.split(), _key_positions(words.split(), key)) for i, (label, words, key) in enumerate(templates)]
    cells = [F.struct(F.lit(t).alias("template"), F.lit(label).alias("label"), F.lit(is_base).alias("is_base"), F.lit(w).alias("word"),
                      F.lit(at).alias("at"), F.lit(at in key).alias("is_key"), F.lit(len(key)).alias("n_key"))
             for t, label, is_base, words, key in rows for at, w in enumerate(words)]
    return spark.range(1).select(F.explode(F.array(*cells)).alias("p")).select("p.*")


def _words(text: Column) -> Column:
    return F.split(F.translate(F.regexp_replace(F.coalesce(text, F.lit("")), "^" + SEPARATORS.replace(r"\x3A-\x60", r"\x3A-\x40\x5B-\x60"), ""),
                               ALPHABET, ALPHABET.lower()), SEPARATORS)


def index(docs: DataFrame, base=BASE, templates=TEMPLATES) -> DataFrame:
    """(rid, doc_id, n_words, hits array<struct<word, pos>>) of every row of ``docs``."""
    vocabulary = {w for words, _ in base for w in words.split()} | {w for _, words, _ in templates for w in words.split()}
    rare, common = sorted(vocabulary - COMMON), sorted(vocabulary & COMMON)
    words = F.col("llm_words")

    def hit(w, i):
        beside = w.isin(*common) & F.coalesce((F.get(words, i - 1).isin(*rare)) | (F.get(words, i - 2).isin(*rare)) | (F.get(words, i - 3).isin(*rare)), F.lit(False))
        return F.when(w.isin(*rare) | beside, F.struct(w.alias("word"), i.alias("pos")))

    split = docs.select("doc_id", _words(F.col("text")).alias("llm_words"))
    hits = F.filter(F.transform(words, hit), lambda x: x.isNotNull())
    # a text that ends in a separator splits into one empty word at its end; so does the empty text
    n = F.size(words) - F.when(F.element_at(words, -1) == "", 1).otherwise(0)
    return materialize(split.select(F.monotonically_increasing_id().alias("rid"), "doc_id", n.cast("long").alias("n_words"), hits.alias("hits")), "postings")


def scan(docs: DataFrame, base=BASE, templates=TEMPLATES, min_share: float = MIN_SHARE) -> DataFrame:
    spark = prepare(docs.sparkSession)
    table = index(docs.select("doc_id", "text"), base, templates)
    per_word = table.select(F.explode(F.array_distinct(F.transform("hits", lambda h: h["word"]))).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    total = table.count()
    # at most as many rows as the templates have words
    idf = materialize(per_word.select("word", F.log1p(F.lit(float(total)) / F.col("df")).alias("idf")), "idf")
    tokens = table.where(F.size("hits") > 0).select("rid", F.explode("hits").alias("h")).select("rid", "h.word", "h.pos")
    postings = _postings(spark, base, templates)
    # few hundred rows: the words of the templates with their weights, none where no file holds the word
    postings = postings.join(F.broadcast(idf), "word", "left")
    rarest = Window.partitionBy("template").orderBy(F.desc("is_key"), F.desc_nulls_first("idf"), "at")
    postings = postings.withColumn("stands", F.row_number().over(rarest) == 1).withColumn("mass", F.sum("idf").over(Window.partitionBy("template")))
    postings = materialize(postings.withColumn("idf", F.coalesce("idf", F.lit(0.0))), "templates")
    about = ["template", "label", "is_base", "mass", "n_key"]
    named = tokens.join(F.broadcast(postings.where("stands")), "word").select("rid", *about, (F.col("pos") - F.col("at")).alias("shift"))
    # the other words of a named place, at their positions; the file's postings are met by position, so a long file is spread
    wanted = named.join(F.broadcast(postings.select("template", "word", "at", "is_key", "idf")), "template").withColumn("pos", F.col("shift") + F.col("at"))
    aligned = wanted.join(tokens, ["rid", "pos", "word"])
    places = aligned.groupBy("rid", *about, "shift").agg(
        F.sum("idf").alias("share"), F.sum(F.col("is_key").cast("int")).alias("keys")).where(F.col("keys") == F.col("n_key"))
    share = F.least(F.lit(1.0), F.col("share") / F.col("mass"))
    full = F.col("is_base")
    said = ~full & (share >= min_share)
    found = places.groupBy("rid").agg(
        F.count_if(full).alias("n_base"), F.min(F.when(full, F.col("shift"))).cast("long").alias("first_word"),
        F.max(F.when(full, F.col("shift"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(full, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(full | said, F.col("label")))), ",").alias("labels"),
        F.max(F.when(~full, share)).alias("score"), F.max(full).alias("any_base"))
    found = found.withColumn("score", F.greatest(F.coalesce("score", F.lit(0.0)), F.when(F.col("any_base"), 0.5).otherwise(0.0)))
    nothing = F.lit("")
    return table.select("rid", "doc_id", "n_words").join(found, "rid", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", nothing).alias("base_labels"), F.coalesce("labels", nothing).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"))


def op10(spark: SparkSession, docs: DataFrame) -> DataFrame:
    prepare(spark)
    return scan(docs)
