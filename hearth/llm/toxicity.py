"""Toxicity by a weighted finite-state pattern grammar over clauses.

A lexicon maps the words of a clause to symbols: insult, threat, target, negation,
report, contrast, other. Insult words and stems are learned from labelled documents, with
their log-odds as weights; the other classes are short fixed lists. Five weighted
transducers read symbols, write symbols, and add weights on their arcs:

    report     rewrites insults and threats behind a reporting word, up to a contrast, to "reported"
    negation   rewrites insults and threats in the ``SCOPE`` words behind a negation to "negated"
    insult     weighs every insult (the first three in a clause count)
    threat     weighs a threat followed by a target, or the other way round
    target     weighs an insult and a target in one clause

They are composed in this order: each reads what the one before wrote, so a negated or reported
insult is none to those that weigh, whatever its learned weight. The composition is one
transducer; a clause's score is the weight of its path, and a clause that scores over ``MATCH`` is a
match. A document's score is a logistic function of its best clause, the sum and the number of
matches per word; the coefficients are fitted on labelled documents too. Isolated words do not
score: the same word counts nothing in a negated or reported clause.

Fit: at most ``max_train`` labelled rows with crc32(doc_id as text) mod 3 <> 1, the smallest
hashes of ids (a bounded sample); near-copies among them count once for the lexicon.
Inputs of a score are the text's words alone.

Cases: null, blank and wordless texts get the score of no match. Null ids are not held
out. Repeated rows score alike. Without labels, or with one kind, the fixed lists and
``PRIOR`` coefficients stand. Texts are read whole. Empty tables give empty results.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearth.llm.common import map_batches, prepare, stream_batches, utf8
from hearth.session import materialize

MAX_TRAIN = 6000
MIN_G2 = 20.0
MIN_SHARE = 0.8
STEMS = (5, 6, 7, 8)
THRESHOLD = 0.7
MAX_WEIGHT = 10.0
MATCH = 0.25

INSULT, THREAT, TARGET, NEGATION, REPORT, CONTRAST, OTHER = "insult", "threat", "target", "negation", "report", "contrast", "other"
REPORTED, NEGATED = "reported", "negated"
#: Words behind a negation that it governs; a governed insult or threat starts the count anew ("an idiot or a moron").
SCOPE = 6
#: Word lists in the four languages of the corpora.
INSULTS = "idiot idiots moron imbecile bastard scumbag idiota imbécil estúpido cretino imbécile connard crétin dummkopf trottel arschloch".split()
THREATS = "kill hurt destroy murder beat strangle töten umbringen vernichten schlagen tuer frapper détruire matar destruir golpear".split()
TARGETS = "you your you're they them he she du dich dir ihr euch sie tu te toi vous vos tú ti usted ustedes vosotros".split()
NEGATIONS = "not never no isn't aren't nicht kein keine nie pas jamais ne non nunca jamás".split()
REPORTS = "said says claimed quoted reported wrote called sagte schrieb zitierte dit écrit cité dijo escribió citó".split()
CONTRASTS = "but however aber sondern doch mais cependant pero sino".split()

CLAUSE = re.compile(r"[.!?;:\n]+")
#: ASCII other than letters and the apostrophe parts words; other bytes belong to them.
_FOLD = bytes(c if c >= 128 or 97 <= c <= 122 or c == 39 else 32 for c in range(256))


@dataclass(frozen=True)
class Transducer:
    """Arcs (state, symbol read) -> (state, symbol written, weight); no arc: stay, write what was read, weight 0."""

    arcs: dict[tuple[int, str], tuple[int, str, float]]
    start = 0

    def step(self, state: int, symbol: str) -> tuple[int, str, float]:
        return self.arcs.get((state, symbol), (state, symbol, 0.0))


class Composed:
    """The composition of two transducers: the second reads what the first writes. Its states are
    pairs; its arcs are made when a text first needs them (there are finitely many)."""

    def __init__(self, first: "Transducer | Composed", second: "Transducer | Composed"):
        self.first, self.second, self.start = first, second, (first.start, second.start)
        self.arcs: dict[tuple[tuple, str], tuple[tuple, str, float]] = {}

    def step(self, state: tuple, symbol: str) -> tuple[tuple, str, float]:
        key = state, symbol
        if key not in self.arcs:
            a, between, v = self.first.step(state[0], symbol)
            b, written, w = self.second.step(state[1], between)
            self.arcs[key] = (a, b), written, v + w
        return self.arcs[key]

    def weight(self, clause: Iterable[tuple[str, float]]) -> float:
        """Path weight of (symbol, word weight) pairs; an arc over a word is scaled by its weight."""
        state, total = self.start, 0.0
        for symbol, w in clause:
            state, _, arc = self.step(state, symbol)
            total += arc * w
        return total


def weigher(*arcs: tuple[int, str, int, float]) -> Transducer:
    """A transducer that writes what it reads, from (state, symbol, next state, weight)."""
    return Transducer({(s, x): (t, x, w) for s, x, t, w in arcs})


def grammar() -> tuple[Transducer, ...]:
    """report, negation, insult, threat, target. Insult arcs weigh in units of the word's
    own weight, threats in absolute units."""
    report = Transducer({(0, REPORT): (1, REPORT, 0.0), (1, CONTRAST): (0, CONTRAST, 0.0),
                         (1, INSULT): (1, REPORTED, 0.0), (1, THREAT): (1, REPORTED, 0.0)})
    # state k: the next k words are governed
    governed: dict[tuple[int, str], tuple[int, str, float]] = {(0, NEGATION): (SCOPE, NEGATION, 0.0)}
    for k in range(1, SCOPE + 1):
        governed |= {(k, x): (k - 1, x, 0.0) for x in (OTHER, TARGET, REPORT, REPORTED)}
        governed |= {(k, NEGATION): (SCOPE, NEGATION, 0.0), (k, CONTRAST): (0, CONTRAST, 0.0),
                     (k, INSULT): (SCOPE, NEGATED, 0.0), (k, THREAT): (SCOPE, NEGATED, 0.0)}
    insult = weigher((0, INSULT, 1, 1.0), (1, INSULT, 2, 0.5), (2, INSULT, 3, 0.25))
    threat = weigher((0, THREAT, 1, 0.2), (1, TARGET, 3, 2.0), (0, TARGET, 2, 0.0), (2, THREAT, 3, 2.0))
    target = weigher((0, TARGET, 1, 0.0), (1, INSULT, 3, 0.5), (0, INSULT, 2, 0.0), (2, TARGET, 3, 0.5))
    return report, Transducer(governed), insult, threat, target


def machine() -> Composed:
    return reduce(Composed, grammar())


@dataclass(frozen=True)
class Lexicon:
    """Insult words and stems with weights; the other classes are fixed."""

    words: dict[str, float]
    stems: dict[str, float]

    def lookup(self) -> tuple[dict[bytes, tuple[str, float]], dict[int, dict[bytes, tuple[str, float]]]]:
        exact = {w.encode(): (s, 1.0) for s, ws in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (CONTRAST, CONTRASTS)) for w in ws}
        exact |= {w.encode(): (INSULT, v) for w, v in self.words.items()}
        stems: dict[int, dict[bytes, tuple[str, float]]] = {}
        for w, v in self.stems.items():
            stems.setdefault(len(w.encode()), {})[w.encode()] = INSULT, v
        return exact, stems


#: Coefficients (bias, best clause, log of the sum, matches per 100 words) without training.
PRIOR = (-3.0, 2.0, 1.0, 0.5)
SEED_LEXICON = Lexicon({w: 2.0 for w in INSULTS}, {})


class Scanner:
    """Clause features of texts under a lexicon."""

    def __init__(self, lexicon: Lexicon):
        self.exact, self.stems = lexicon.lookup()
        self.hot = {w for w, (s, _) in self.exact.items() if s in (INSULT, THREAT)}
        self.machine = machine()

    def symbol(self, word: bytes) -> tuple[str, float]:
        got = self.exact.get(word)
        if got is None:
            for n, table in self.stems.items():
                got = table.get(word[:n])
                if got is not None:
                    break
        return got or (OTHER, 1.0)

    def features(self, text: str | None) -> tuple[float, float, float, int]:
        """(best clause, log of the sum, matches per 100 words, matches)."""
        lower = (text or "").lower()
        words = lower.encode("utf-8", "surrogatepass").translate(_FOLD).split()
        distinct = set(words)
        if not words or (self.hot.isdisjoint(distinct) and not any(not t.keys().isdisjoint({w[:n] for w in distinct}) for n, t in self.stems.items())):
            return 0.0, 0.0, 0.0, 0
        best = total = 0.0
        matches = 0
        for clause in CLAUSE.split(lower):
            w = self.machine.weight(map(self.symbol, utf8(clause).translate(_FOLD).split()))
            if w > MATCH:
                best, total, matches = max(best, w), total + w, matches + 1
        return best, math.log1p(total), 100.0 * matches / len(words), matches


# --- training ---------------------------------------------------------------


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def _tokens(text: str | None) -> set[str]:
    """Distinct words and marked stems (``abcde*``) of a text."""
    words = {w.decode("utf-8", "replace") for w in (text or "").lower().encode("utf-8", "surrogatepass").translate(_FOLD).split() if len(w) > 2}
    return words | {w[:n] + "*" for w in words for n in STEMS if len(w) >= n}


def _copy_key(text: str | None) -> int:
    """Smallest hash of the text's four-word shingles: near-copies mostly share it."""
    words = utf8(text).lower().split()
    return min((xxhash.xxh64_intdigest(b" ".join(words[i:i + 4])) >> 1 for i in range(max(1, len(words) - 3))), default=0)


def _g2(n_tox: int, n_non: int) -> Column:
    """Likelihood ratio of a token's counts (tox, non) against independence; 0 if it is rarer in toxic texts."""
    n, tox, non = float(n_tox + n_non), F.col("tox"), F.col("non")
    k = tox + non
    cells = ((tox, k * n_tox / n), (non, k * n_non / n), (n_tox - tox, (n - k) * n_tox / n), (n_non - non, (n - k) * n_non / n))
    total = sum((F.when((a > 0) & (b > 0), a * F.ln(a / b)).otherwise(0.0) for a, b in cells), F.lit(0.0))
    return F.when(tox * n_non > non * n_tox, 2 * total).otherwise(0.0)


def _sample(docs: DataFrame, labels: DataFrame, max_train: int) -> DataFrame:
    ids = (labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
           .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train))
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")  # at most max_train ids


def _logistic(x: np.ndarray, y: np.ndarray, l2: float = 0.002, steps: int = 60) -> tuple[float, ...]:
    """Ridge logistic regression by Newton steps."""
    a = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(a.shape[1])
    ridge = np.diag([1e-6] + [l2] * x.shape[1]) * len(x) / 100
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (p - y) + ridge @ w
        step = np.linalg.solve(a.T @ (a * np.maximum(p * (1 - p), 1e-6)[:, None]) + ridge, grad)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(w.tolist())


def learn_lexicon(sample: DataFrame) -> Lexicon:
    """``sample(doc_id, text, toxic)``: tokens that mark toxic documents. Counts and their
    test are made on executors; only tokens that pass it, of the bounded sample, reach the driver."""

    def prepare_rows():
        def step(cols):
            return {"copy": [_copy_key(t) for t in cols["text"]], "toxic": cols["toxic"], "text": cols["text"]}
        return step

    rows = map_batches(sample, prepare_rows, "copy long, toxic int, text string")
    rows = materialize(rows.groupBy("copy", "toxic").agg(F.min("text").alias("text")), "sample")
    n = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_tox, n_non = n.get(1, 0), n.get(0, 0)
    if not n_tox or not n_non:
        return SEED_LEXICON

    def count(batches):
        counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for cols in batches:
            for t, y in zip(cols["text"], cols["toxic"]):
                counts[y].update(_tokens(t))
        for y, c in counts.items():
            tokens = list(c)
            for i in range(0, len(tokens), 50_000):
                part = tokens[i:i + 50_000]
                yield {"token": part, "toxic": [y] * len(part), "n": [c[t] for t in part]}

    counts = stream_batches(rows, count, "token string, toxic int, n long").groupBy("token").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("tox"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("non"))
    likely = counts.where((F.col("tox") >= 3) & (F.col("tox") >= MIN_SHARE * (F.col("tox") + F.col("non"))) & (_g2(n_tox, n_non) >= MIN_G2))
    words, stems = {}, {}
    for r in sorted(likely.collect(), key=lambda r: (not r.token.endswith("*"), len(r.token), r.token)):
        weight = min(MAX_WEIGHT, math.log(((r.tox + 0.5) / (n_tox + 1)) / ((r.non + 0.5) / (n_non + 1))))
        token = r.token.rstrip("*")
        if any(token.startswith(s) for s in stems):
            continue
        (stems if r.token.endswith("*") else words)[token] = weight
    seeds = {w: 2.0 for w in INSULTS if not any(w.startswith(s) for s in stems)}
    return Lexicon(seeds | words, stems)


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> tuple[Lexicon, tuple[float, ...]]:
    """Lexicon and coefficients from the training rows."""
    prepare(docs.sparkSession)
    sample = materialize(_sample(docs, labels, max_train), "labelled")
    lexicon = learn_lexicon(sample)
    rows = features(sample, lexicon, ["toxic"]).select("toxic", "best", "total", "density", "doc_id")
    rows = rows.orderBy(F.xxhash64("doc_id"), *rows.columns).limit(2 * max_train).collect()  # ids may repeat
    y = np.array([r.toxic for r in rows], float)
    if len(set(y.tolist())) < 2:
        return lexicon, PRIOR
    return lexicon, _logistic(np.array([[r.best, r.total, r.density] for r in rows]), y)


def features(docs: DataFrame, lexicon: Lexicon, keep: list[str]) -> DataFrame:
    kept = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in keep)

    def make():
        scanner = Scanner(lexicon)

        def step(cols):
            f = [scanner.features(t) for t in cols["text"]]
            return {"doc_id": cols["doc_id"], "best": [x[0] for x in f], "total": [x[1] for x in f], "density": [x[2] for x in f],
                    "n_matches": [x[3] for x in f]} | {c: cols[c] for c in keep}
        return step

    return map_batches(docs.select("doc_id", "text", *keep), make, "doc_id long, best double, total double, density double, n_matches long" + kept)


def score(docs: DataFrame, lexicon: Lexicon, coefficients: tuple[float, ...]) -> DataFrame:
    """doc_id, held_out, score, predicted, n_matches (matched clauses)."""
    prepare(docs.sparkSession)
    b = [F.lit(float(c)) for c in coefficients]
    z = b[0] + b[1] * F.col("best") + b[2] * F.col("total") + b[3] * F.col("density")
    rows = features(docs, lexicon, []).withColumn("score", 1 / (1 + F.exp(-z)))
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_matches")


def op4(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    prepare(spark)
    return score(docs, *fit(docs, labels))
