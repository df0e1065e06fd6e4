import itertools
import math
import random
import re
from collections import Counter

import numpy as np

from hearth.llm import quality, secret_scan

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_base(text):
    w = words(text)
    grams = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    hit = {i + j for i in range(len(w) - 2) if grams[tuple(w[i:i + 3])] > 1 for j in range(3)}
    lines = (text or "").split("\n")
    dups = sum(1 for i, x in enumerate(lines) if words(x) and x in set(lines[:i]))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dups, len(hit)


def test_base_counts_match_brute_force(whole):
    rows = whole.select("doc_id", "text").collect()
    got = quality.judge(whole, quality.PRIOR).collect()
    want = Counter((r.doc_id, *brute_base(r.text)) for r in rows)
    assert Counter((g.doc_id, g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) for g in got) == want
    for g in got:
        assert g.base_failed == (g.n_words < 50 or 100 * g.n_repeat_words > 50 * g.n_words)
        assert not (g.base_failed and g.kept)


def test_viterbi_is_the_best_path():
    rng = random.Random(3)
    for _ in range(50):
        n = rng.randint(1, 7)
        em = [rng.uniform(-2, 2) for _ in range(n)]
        crf = quality.LineCRF((), tuple(rng.uniform(-1, 1) for _ in range(4)), (rng.uniform(-1, 1), rng.uniform(-1, 1)))

        def score(path):
            s = crf.start[path[0]] + sum(e for e, p in zip(em, path) if p)
            return s + sum(crf.transitions[2 * a + b] for a, b in zip(path, path[1:]))

        best = max(map(score, itertools.product((0, 1), repeat=n)))
        assert abs(score(quality.viterbi(em, crf)) - best) < 1e-9


def test_gradient_of_the_likelihood():
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(9, 4)), rng.integers(0, 2, 9)
    at, t_at = np.repeat([0, 1, 2], [2, 3, 4]), np.concatenate([np.arange(k) for k in (2, 3, 4)])
    theta = rng.normal(size=10)
    f = lambda t: quality._log_likelihood(t, x, y, at, t_at, (3, 4), 1e-3)
    _, g = f(theta)
    for i in range(10):
        d = np.zeros(10)
        d[i] = 1e-6
        assert abs((f(theta + d)[0] - f(theta - d)[0]) / 2e-6 - g[i]) < 1e-5


def test_trained_field_agrees_with_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    crf = quality.train(docs, labels)
    rows = quality.judge(docs, crf).join(labels, "doc_id").where("not base_failed").collect()
    right = sum(r.kept == bool(r.quality) for r in rows)
    assert right >= 0.95 * len(rows)
    clean = [r for r in rows if r.quality == 1]
    assert sum(r.kept for r in clean) >= 0.99 * len(clean)


def test_filter_keeps_columns_and_edge_cases(edge, empty, labels):
    kept = quality.filter_documents(edge, quality.PRIOR)
    assert kept.columns == edge.columns
    judged = Counter(r.doc_id for r in quality.judge(edge, quality.PRIOR).where("kept").collect())
    assert Counter(r.doc_id for r in kept.collect()) == judged
    assert quality.judge(empty, quality.train(empty, labels)).count() == 0
    assert quality.train(edge, labels.limit(0)) == quality.PRIOR


def brute_secrets(text):
    text = text or ""
    out = []
    pat = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out += [(m.start(), 0, m.end()) for m in re.finditer(pat, text) if len(m.group(2)) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 16]
    return sorted(out)


def test_base_secrets_match_brute_force(whole):
    want = Counter()
    for r in whole.select("doc_id", "text").collect():
        b = brute_secrets(r.text)
        want[(r.doc_id, *[sum(k == i for _, k, _ in b) for i in range(3)])] += 1
        assert set(b) <= set(secret_scan.base_spans(r.text or ""))
    assert Counter((g.doc_id, g.n_assign, g.n_access, g.n_hex) for g in secret_scan.scan(whole).collect()) == want


def test_tricky_base_matches():
    for text in ("token=secret:abcdefghijklmnop", "password = 'ſecret'", "TOKEN:'AbCdEf123456789'", "toKen=abcdefghijklmnop", "api_key=x apikey: yyyyyyyyyyyyyyyy",
                 "AKIAAKIA1234567890", "aaaaaaaaaaaaaaaaAKIA", "secret\"  =  \"0123456789ab", "passwd::abcdefghijklmn"):
        assert secret_scan.base_spans(text) == brute_secrets(text)


def test_lexer_pairs_and_constants():
    text = 'part = "aB3dE5gH7j"\nclient_secret = part + "K9mNpQ2r"\nexport DB_PWD=Zk39fkJd02Qp\ntitle = "A long harmless title"\npassword = "changeme-changeme"\nx == y'
    got = dict(secret_scan.pairs(text))
    assert got["client_secret"].value == "aB3dE5gH7jK9mNpQ2r" and len(got["client_secret"].spans(set())) == 2
    spans = {text[s:e] for s, _, e in secret_scan.pair_spans(text, secret_scan.base_spans(text))}
    assert {"aB3dE5gH7j", "Zk39fkJd02Qp"} <= spans
    assert not spans & {"A long harmless title", "changeme-changeme"}
    assert secret_scan.pairs("<apiKey>q8W7e6R5t4Y3</apiKey>")[0][1].value == "q8W7e6R5t4Y3"
    assert secret_scan.scan_text(None)[:3] == (0, 0, 0)


def test_names_and_gaps_of_any_length():
    for name in ("x" * 130 + "_password", "a.b-c$" * 30 + ".password", "password" + " " * 125, "password" + "\t" * 5000, 'p' * 9000 + '_token"'):
        text = f"first = 1;\n{name}= 'Zk39fkJd02QpLx7'"
        assert [(n, x.value) for n, x in secret_scan.pairs(text)] == [("first", "1"), (name.strip(' \t"'), "Zk39fkJd02QpLx7")]
    assert any(k == 3 for _, k, _ in secret_scan.pair_spans("key." * 50 + "passphrase: Zk39fkJd02QpLx7", []))


def test_names_match_one_pattern_over_the_whole_text():
    pattern = re.compile(r"""(?a)(?<![\w$.-])([A-Za-z_$][\w$.-]*)["'`]?[ \t]*\Z""")
    rng = random.Random(11)
    for _ in range(20_000):
        left = "".join(rng.choice("aZ_$.-0é'\"` \t\n(") for _ in range(rng.randrange(9)))
        want = pattern.search(left)
        assert secret_scan._name_left(left) == (want.group(1) if want else None), left


def test_doubling_constants_cost_a_line_each():
    import time

    first = "abcdefgh1234ABCD"
    text = f'a0 = "{first}"\n' + "".join(f"a{i + 1}=a{i}+a{i}\n" for i in range(300)) + "client_secret = a300 + a299\n"
    text += 'e0 = ""\n' + "".join(f"e{i + 1}=e{i}+e{i}\n" for i in range(300)) + 'db_password = e300 + "Zk39fkJd02Qp" + e300\n'
    text += 'c0 = "q9"\n' + "".join(f'signing_secret = c{i}\nc{i + 1} = c{i} + "Xy7"\n' for i in range(2000))
    began = time.perf_counter()
    spans = secret_scan.pair_spans(text, [])
    assert time.perf_counter() - began < 1.0
    assert text.index(first) in [s for s, _, _ in spans] and text.index("Zk39") in [s for s, _, _ in spans]
    assert sum(text[s:e] == "Xy7" for s, _, e in spans) == 1999
    literal = dict(secret_scan.pairs(text))["client_secret"]
    assert literal.length == 16 * (2 ** 300 + 2 ** 299) and literal.counts()["a"] == 2 ** 300 + 2 ** 299


def expanded(text):
    """Pairs and spans with every constant written out: small texts only."""
    out, known = [], {}
    for line in text.split("\n"):
        name, _, right = line.partition(" = ")
        value, spans = "", []
        at = text.index(line) + len(name) + 3
        for term in right.split(" + "):
            if term in known:
                value, spans = value + known[term][0], spans + known[term][1]
            else:
                value, spans = value + term[1:-1], spans + [(at + 1, at + len(term) - 1)]
            at += len(term) + 3
        known[name] = value, spans
        out.append((name, value, spans))
    return out


def strong(value):
    n = len(value)
    if n < 8 or " " in value or secret_scan.PLACEHOLDER.search(value):
        return 0.0
    counts = Counter(value)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    classes = sum((any(c.islower() for c in value), any(c.isupper() for c in value), any(c.isdigit() for c in value), not value.isalnum()))
    return min(1.0, n / 20) * 0.3 + min(1.0, entropy / 4) * 0.4 + min(1.0, (classes - 1) / 2) * 0.3


def test_constants_equal_written_out_ones():
    rng = random.Random(8)
    pieces = ["aB3", "dE5gH", "9mNpQ2rT", "", "xx", "X", "cha", "ngeme", "{", "}", "${", "%(", ")", "<", ">", "q" * 60, "your", "_", "a b"]
    for _ in range(400):
        names = [f"k{i}_{rng.choice(['secret', 'name', 'token'])}" for i in range(rng.randint(1, 8))]
        lines = []
        for i, n in enumerate(names):
            terms = [rng.choice(names[:i]) if i and rng.random() < 0.6 else f'"{rng.choice(pieces)}{i if rng.random() < 0.5 else ""}"' for _ in range(rng.randint(1, 5))]
            lines.append(f"{n} = " + " + ".join(terms))
        text = "\n".join(lines)
        want = expanded(text)
        assert [(n, x.value, sorted(set(x.spans(set())))) for n, x in secret_scan.pairs(text)] == [(n, v, sorted({s for s in spans if s[1] > s[0]})) for n, v, spans in want]
        spans = {(s, 3, e) for n, v, own in want if secret_scan.sensitivity(n) * strong(v) >= 0.5 for s, e in own if e > s}
        assert secret_scan.pair_spans(text, []) == sorted(spans), text


def test_placeholder_automaton_equals_the_pattern():
    rng = random.Random(9)
    pieces = ["x", "xx", "X", "*", "**", "change", "_", "me", "ExAm", "ple", "place", "holder", "your", "-", "dum", "my", "<", ">", "$", "{", "}", "%", "(", ")", "\n", "a", "K", "ſ"]
    found = 0
    for _ in range(4000):
        parts = [rng.choice(pieces) for _ in range(rng.randint(1, 9))]
        long = secret_scan.Literal([("z" * 300, 0, 300), secret_scan.Literal([(p, 0, len(p)) for p in parts])])
        want = bool(secret_scan.PLACEHOLDER.search("z" * 300 + "".join(parts)))
        assert secret_scan.is_placeholder(long, {}) == want, parts
        found += want
    assert 150 < found < 3600
