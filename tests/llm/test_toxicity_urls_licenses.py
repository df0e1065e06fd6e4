import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from hearth.llm import licenses, toxicity, url_filter

SF001 = "/root/testdata/sf0.001"


def clause(text, lexicon=toxicity.SEED_LEXICON):
    s = toxicity.Scanner(lexicon)
    return s.machine.weight(map(s.symbol, text.encode().split()))


def test_grammar_scores_clauses_not_words():
    plain, aimed = clause("an idiot"), clause("you are an idiot")
    assert 0 < plain < aimed
    assert clause("i will kill you") > clause("kill") > 0
    assert clause("idiot idiot idiot idiot idiot") == clause("idiot idiot idiot")
    assert clause("") == clause("nothing here at all") == 0


@pytest.mark.parametrize("weight", [0.1, 2.0, 10.0, 1e6])
def test_negated_and_reported_clauses_never_match(weight):
    lexicon = toxicity.Lexicon({"idiot": weight, "moron": weight}, {"clow": weight})
    for text in ("not an idiot", "you are not an idiot", "you are never an idiot or moron", "he said you are an idiot", "she wrote they are clowns and you a moron",
                 "i will not kill you", "never kill them", "he said he will kill you", "nobody claimed you are not an idiot", "no clown no moron no idiot and no moron"):
        assert clause(text, lexicon) <= toxicity.MATCH, text
    for text in ("you are not smart but an idiot", "he said little but you are an idiot", "not one of us here was ever a clown of your kind you idiot moron"):
        assert clause(text, lexicon) >= weight, text


def cascade(symbols, weights):
    """Total weight by running one transducer after the other over the whole string."""
    total = 0.0
    for part in toxicity.grammar():
        state, out = part.start, []
        for x, w in zip(symbols, weights):
            state, y, v = part.step(state, x)
            total += v * w
            out.append(y)
        symbols = out
    return total


def test_composition_equals_the_cascade():
    kinds = (toxicity.INSULT, toxicity.THREAT, toxicity.TARGET, toxicity.NEGATION, toxicity.REPORT, toxicity.CONTRAST, toxicity.OTHER)
    machine = toxicity.machine()
    for length in range(6):
        for seq in itertools.product(kinds, repeat=length):
            weights = [1.0 + 0.5 * i for i in range(length)]
            assert abs(machine.weight(zip(seq, weights)) - cascade(list(seq), weights)) < 1e-12


def brute_score(text, lexicon, coefficients):
    """A document's score and matches, word by word and transducer by transducer."""
    lists = [(toxicity.THREAT, toxicity.THREATS), (toxicity.TARGET, toxicity.TARGETS), (toxicity.NEGATION, toxicity.NEGATIONS), (toxicity.REPORT, toxicity.REPORTS), (toxicity.CONTRAST, toxicity.CONTRASTS)]

    def symbol(word):
        if word in lexicon.words:
            return toxicity.INSULT, lexicon.words[word]
        for kind, own in lists:
            if word in own:
                return kind, 1.0
        stems = [s for s in lexicon.stems if word.encode("utf-8", "surrogatepass")[:len(s.encode())] == s.encode()]
        return (toxicity.INSULT, lexicon.stems[stems[0]]) if stems else (toxicity.OTHER, 1.0)

    n, found = 0, []
    for part in re.split(r"[.!?;:\n]+", (text or "").lower()):
        words = re.findall(r"[a-z'\x80-\U0010ffff]+", part)
        n += len(words)
        if words:
            symbols, weights = zip(*map(symbol, words))
            w = cascade(list(symbols), weights)
            if w > toxicity.MATCH:
                found.append(w)
    b = coefficients
    z = b[0] + (b[1] * max(found) + b[2] * math.log1p(sum(found)) + b[3] * 100 * len(found) / n if found else 0.0)
    return 1 / (1 + math.exp(-z)), len(found)


def test_scores_against_brute_force(spark, whole, labels):
    lexicon, coefficients = toxicity.fit(*(spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels")))
    extra = ["you idiot", "you are not an idiot. you moron!", "he said: you idiot; kill them", "i will kill you but not an idiot\nyou are a clown", "Moron IDIOT."]
    rows = whole.select("doc_id", "text").unionByName(spark.createDataFrame([(9000 + i, t) for i, t in enumerate(extra)], "doc_id long, text string"))
    want = defaultdict(list)
    for r in rows.collect():
        want[r.doc_id].append(brute_score(r.text, lexicon, coefficients))
    got = toxicity.score(rows, lexicon, coefficients).collect()
    assert len(got) == sum(map(len, want.values())) and sum(g.n_matches > 0 for g in got) > 5
    for g in got:
        assert any(abs(g.score - s) < 1e-9 and g.n_matches == n for s, n in want[g.doc_id]), g
        assert g.predicted == (g.score >= 0.7) and g.held_out == (g.doc_id is not None and zlib.crc32(str(g.doc_id).encode()) % 3 == 1)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.op4(spark, docs, labels).join(labels, "doc_id").where("held_out").collect()
    toxic, clean = [r for r in rows if r.toxic], [r for r in rows if not r.toxic]
    assert sum(r.predicted for r in toxic) >= 0.85 * len(toxic)
    assert sum(r.predicted for r in clean) <= 0.01 * len(clean)


def test_training_reads_no_held_out_label(spark, docs, labels):
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit(docs, labels) == toxicity.fit(docs, flipped)


def test_toxicity_edge_cases(edge, empty, labels):
    lexicon, coefficients = toxicity.fit(edge, labels.limit(0))
    assert (lexicon, coefficients) == (toxicity.SEED_LEXICON, toxicity.PRIOR)
    rows = toxicity.score(edge, lexicon, coefficients).collect()
    assert len(rows) == edge.count() and all(0 <= r.score <= 1 for r in rows)
    by = {r.doc_id: r for r in rows}
    assert by[20].predicted == 1 and by[3].score == by[4].score and by[None].held_out is False
    assert toxicity.score(empty, lexicon, coefficients).count() == 0


URLS = [(1, "http://Sub.Example.ORG/es/x?q=1#f"), (2, "https://example.org/en/12"), (3, "https://example.org/en/2"), (4, "http://a.com/fr/"),
        (5, "http://com/de/x"), (6, "http://notcom/de/x"), (7, None), (8, "no scheme/at/all"), (9, ""), (10, "ftp://x.net?q=/org/#a"), (11, "x://"),
        (12, "http://org#/"), (13, "http://xorg/"), (13, "http://xorg/"), (None, "http://b.org/"), (14, "http://É.com/fr/É?" + "a=1&" * 3000),
        (15, "a://b://c/d"), (16, "http://x.org?/es/")]


def brute_url(url):
    _, found, rest = (url or "").partition("://")
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]
    host = host.translate({c: c + 32 for c in range(65, 91)})
    fits = [(h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule = max(fits, key=lambda f: len(f[0]), default=(None, None))
    return (host, path, *rule) if found else ("", "", None, None)


@pytest.fixture(scope="module")
def pages(spark):
    extra = spark.createDataFrame(URLS, "page_id long, url string")
    return spark.read.parquet(f"{SF001}/pages.parquet").select("page_id", "url").unionByName(extra)


def test_urls_match_brute_force(spark, pages):
    got = url_filter.op6(spark, pages.withColumn("host", F.lit("x")).withColumn("y", F.lit(1))).collect()
    want = Counter((r.page_id, *brute_url(r.url)[:3]) for r in pages.collect())
    assert Counter((g.page_id, g.host, g.path, g.rule) for g in got) == want
    said = {r.url: brute_url(r.url)[3] for r in pages.collect()}
    by_rule = dict((brute_url(u)[2], v) for u, v in said.items() if v)
    assert all(g.verdict == by_rule[g.rule] if g.rule else g.verdict in ("allow", "block") for g in got)


def test_trees_learn_given_labels(spark):
    rows = [(i, f"http://{'bet-win-free' if i % 2 else 'paper'}{i % 7}.net/{'x' * (i % 5)}?{'a=1&' * (6 * (i % 2))}", i % 2) for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string, label int")
    got = {r.page_id: r.verdict for r in url_filter.judge(pages, rules=(), trees=5).collect()}
    assert sum((got[i] == "block") == bool(y) for i, _, y in rows) >= 0.98 * len(rows)


def test_trees_judge_suffixes_unseen_in_training(spark):
    """Every labelled url has a suffix of its own: its label must not reach the trees through the suffix."""
    rows = [(i, f"http://{'a-b-c-d' if bad else 'abcd'}{i % 7}.tld{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{i // 676}x/{'y' * (i % 5)}", bad if i < 400 else None)
            for i in range(600) for bad in [i * 7 % 3 == 0 and 1 or 0]]
    pages = spark.createDataFrame(rows, "page_id long, url string, label int")
    got = {r.page_id: r.verdict for r in url_filter.judge(pages, rules=(), trees=5).collect()}
    assert all((got[i] == "block") == (i * 7 % 3 == 0) for i in range(400, 600))


def test_urls_without_labels(spark, pages):
    assert {r.verdict for r in url_filter.judge(pages, rules=()).collect()} == {"allow"}
    assert {r.verdict for r in url_filter.judge(pages, rules=(("org", "/", "block"),)).collect()} == {"block"}
    assert url_filter.op6(spark, pages.limit(0)).count() == 0


def test_url_plan_is_native(pages):
    plan = url_filter.lexical(pages)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def brute_phrases(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    starts, labels = [], set()
    for phrase, label in licenses.BASE:
        p = phrase.split()
        own = [i for i in range(len(w) - len(p) + 1) if w[i:i + len(p)] == p]
        starts += own
        labels |= {label} if own else set()
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


@pytest.fixture(scope="module")
def notices(spark, whole):
    texts = ["Cc By cc by-nc CC by", "gnu general public gnu general public license apache license", "by cc by", "...MIT... license", "mit license" * 2,
             "Licensed under CC BY-SA 4.0.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
             "Redistribution and use in source and binary forms, with or without modification, are permitted", "apache \x00 LICENSE Kelvin license",
             "the general public said by cc nothing", " ".join(["apache license"] * 5000), "licen\u017fe apache licen\u017fe", "x" * 200_000]
    extra = spark.createDataFrame([(5000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return whole.select("doc_id", "text").unionByName(extra)


def test_licenses_match_brute_force(notices):
    want = Counter((r.doc_id, *brute_phrases(r.text)) for r in notices.collect())
    got = licenses.scan(notices).collect()
    assert Counter((g.doc_id, g.n_words, g.n_base, g.first_word, g.last_word, g.base_labels) for g in got) == want
    for g in got:
        assert 0 <= g.score <= 1 and set(filter(None, g.base_labels.split(","))) <= set(filter(None, g.labels.split(",")))
    by = {g.doc_id: g for g in got}
    assert "cc-by-sa" in by[5005].labels and by[5006].labels == "mit" and by[5007].labels == "bsd" and by[5009].labels == ""
    assert by[18].labels == "apache,apache-2.0,cc-by,cc-by-nc,gpl,mit"


def brute_labels(texts):
    """Labels and score of every text: each template at every shift."""
    split = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) for t in texts]
    templates = [(w.split(), label, w.split()) for w, label in licenses.BASE] + [(w.split(), label, k.split()) for label, w, k in licenses.TEMPLATES]
    rare = {w for words, _, _ in templates for w in words} - licenses.COMMON
    common = {w for words, _, _ in templates for w in words} & licenses.COMMON
    held = [{i: w for i, w in enumerate(ws) if w in rare or (w in common and rare.intersection(ws[max(0, i - 3):i]))} for ws in split]
    df = Counter(w for h in held for w in set(h.values()))
    idf = {w: math.log1p(len(texts) / n) for w, n in df.items()}
    for h in held:
        labels, score = set(), 0.0
        for t, (words, label, key) in enumerate(templates):
            at = next(i for i in range(len(words)) if words[i:i + len(key)] == key)
            places = {pos - words.index(key[0], at) for pos, w in h.items() if w == key[0]}
            mass = sum(idf.get(w, 0.0) for w in words)
            for shift in places:
                if all(h.get(shift + i) == words[i] for i in range(at, at + len(key))):
                    share = min(1.0, sum(idf[w] for i, w in enumerate(words) if h.get(shift + i) == w) / mass)
                    if t < len(licenses.BASE) or share >= licenses.MIN_SHARE:
                        labels.add(label)
                    score = max(score, 0.5 if t < len(licenses.BASE) else share)
        yield ",".join(sorted(labels)), score


def test_labels_and_score_match_a_brute_force_aligner(spark, notices):
    extra = ["SPDX-License-Identifier: BSD-3-Clause", "// SPDX-License-Identifier: MIT OR Apache-2.0", "spdx license identifier gpl 2", "Permission notice shall not",
             "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products", "endorse or promote products",
             "the above copyright notice and this permission notice shall be included in all copies", "free software foundation published by the free software foundation"]
    rows = notices.unionByName(spark.createDataFrame([(7000 + i, t) for i, t in enumerate(extra)], "doc_id long, text string")).collect()
    want = Counter((r.doc_id, labels, round(score, 9)) for r, (labels, score) in zip(rows, brute_labels([r.text for r in rows])))
    got = licenses.scan(spark.createDataFrame(rows, notices.schema)).collect()
    assert Counter((g.doc_id, g.labels, round(g.score, 9)) for g in got) == want
    by = {g.doc_id: g.labels for g in got}
    assert by[7000] == "bsd-3-clause" and by[7002] == "" and by[7004] == "bsd-3-clause" and "mit" in by[7001]


def test_licenses_of_many_notices_in_one_file(spark):
    """Notices of corpus-common words are found beside any number of rarer ones."""
    rows = [(i, "Licensed under the Apache License, Version 2.0") for i in range(50)]
    for i, kept in ((100, ("apache-2.0", "mit", "isc")), (101, [label for label, _, _ in licenses.TEMPLATES])):
        rows.append((i, " ... ".join(words for label, words, _ in licenses.TEMPLATES if label in kept)))
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {"apache-2.0", "mit", "isc"} <= set(got[100].labels.split(","))
    assert {label for label, _, _ in licenses.TEMPLATES} <= set(got[101].labels.split(","))


def test_licenses_empty_and_native(empty, edge):
    assert licenses.scan(empty).count() == 0
    out = licenses.scan(edge)
    assert out.count() == edge.count()
    assert not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().executedPlan().toString())
