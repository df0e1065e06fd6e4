"""Quality rules by line sequence labelling.

Every line of a document is an item of a sequence; a two-state linear-chain
conditional random field (content, boilerplate) scores line features and the
transitions between neighbouring lines, Viterbi decoding marks the lines, and the
share of words in content lines decides whether the document stays.

The field is fitted on labelled documents (``labels.quality``): lines of a good
document count as content unless they repeat an earlier line, lines of a bad one as
boilerplate. Fit: at most ``max_train_docs`` labelled documents (a bounded sample), all lines
of each, in chains of ``CHAIN`` lines.

Cases: a null or blank text has no words: n_words 0, base_failed, not kept. Lines
without a word carry no state. Ties in Viterbi go to content. Repeated rows are
judged one by one. Without any usable label ``PRIOR`` is used. Only ``doc_id`` and
``text`` are read; other columns pass through ``filter_documents`` untouched.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearth.llm.common import map_batches, prepare, utf8

MAX_TRAIN_DOCS = 1000
#: Lines of one training chain; a longer text gives several, so all of its lines are used.
CHAIN = 64
CONTENT_SHARE = 0.5
MIN_WORDS = 50
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
DIGITS = b"0123456789"

RAW = ("n_words", "n_bytes", "symbols", "upper", "digits", "bangs", "pipes", "distinct", "dup", "ends", "high")
FEATURES = ("bias", "words<=2", "words<=6", "words>=20", "symbols>0", "symbols>2%", "symbols>10%", "pipes>=2",
            "upper>20%", "upper>60%", "digits>20%", "bangs>=2", "bangs>5%", "distinct<50%", "distinct<25%", "dup",
            "ends with a full stop", "long words", "short words", "same as the line above in length")


@dataclass(frozen=True)
class LineCRF:
    """Parameters: emission weights of "content" against "boilerplate", the 2 x 2
    transition scores (from, to) and the start scores; state 1 is content."""

    weights: tuple[float, ...]
    transitions: tuple[float, float, float, float]
    start: tuple[float, float]


#: Used when there is nothing to learn from.
PRIOR = LineCRF((1.5, -0.5, -0.2, 0.3, -0.3, -1.0, -2.0, -2.5, -0.5, -2.0, -0.5, -1.0, -1.5, -1.0, -2.0, -1.0, 0.5, 0.0,
                 -0.3, 0.0), (0.5, -0.5, -0.5, 0.5), (0.0, 0.2))


def base_counts(data: bytes) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a UTF-8 text."""
    words = data.split()
    n = len(words)
    if not n:
        return 0, 0, len(data) - len(data.translate(None, SYMBOLS)), 0, 0
    body = b"".join(words)
    # continuation bytes 10xxxxxx are no code points of their own
    chars = len(body) if body.isascii() else len(body.translate(None, bytes(range(0x80, 0xC0))))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    seen: set[bytes] = set()
    dups = 0
    for line in data.split(b"\n"):
        if line in seen:
            dups += 1
        elif line.strip():
            seen.add(line)
    return n, chars, symbols, dups, repeat_words(words)


def repeat_words(words: list[bytes]) -> int:
    """Words inside three-word windows that the text holds twice or more."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    v = len(ids)
    if v == n:
        return 0
    if v < 2_000_000:
        key = (code[:-2] * v + code[1:-1]) * v + code[2:]
    else:  # the product would not fit 64 bits: number the pairs first
        _, pair = np.unique(code[:-1] * v + code[1:], return_inverse=True)
        key = pair[:-1] * v + code[2:]
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    same = sorted_key[1:] == sorted_key[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    hit = np.zeros(n, bool)
    hit[:-2] |= twice
    hit[1:-1] |= twice
    hit[2:] |= twice
    return int(hit.sum())


def line_stats(data: bytes) -> np.ndarray:
    """Raw statistics (``RAW``) of the lines that hold a word, in order."""
    rows = []
    seen: set[bytes] = set()
    for line in data.split(b"\n"):
        words = line.split()
        if not words:
            continue
        size = len(line)
        rows.append((len(words), size, size - len(line.translate(None, SYMBOLS)), size - len(line.translate(None, UPPER)),
                     size - len(line.translate(None, DIGITS)), line.count(b"!"), line.count(b"|"), len(set(words)),
                     line in seen, words[-1][-1:] in b".?!", size - len(line.translate(None, UPPER + LOWER))))
        seen.add(line)
    return np.array(rows, np.float64).reshape(-1, len(RAW))


def features(raw: np.ndarray) -> np.ndarray:
    """Binary features (``FEATURES``) from raw statistics of consecutive lines."""
    n, size, sym, up, dig, bang, pipe, dist, dup, ends, letters = raw.T
    chars = np.maximum(size, 1)
    letters = np.maximum(letters, 1)
    mean = (size - n + 1) / n
    before = np.concatenate(([-1.0], n[:-1])) if len(n) else n
    cols = (np.ones_like(n), n <= 2, n <= 6, n >= 20, sym > 0, sym > 0.02 * chars, sym > 0.1 * chars, pipe >= 2,
            up > 0.2 * letters, up > 0.6 * letters, dig > 0.2 * chars, bang >= 2, bang > 0.05 * chars, dist < 0.5 * n,
            dist < 0.25 * n, dup > 0, ends > 0, mean > 9, mean < 3.5, before == n)
    return np.stack(cols, axis=1).astype(np.float64)


def viterbi(emission: list[float], crf: LineCRF) -> list[int]:
    """Best state sequence; ``emission`` scores content against boilerplate (0)."""
    if not emission:
        return []
    bb, bc, cb, cc = crf.transitions
    b, c = crf.start[0], crf.start[1] + emission[0]
    back = []
    for e in emission[1:]:
        from_b = b + bb, c + cb
        from_c = b + bc, c + cc
        back.append((int(from_b[1] >= from_b[0]), int(from_c[1] >= from_c[0])))
        b, c = max(from_b), max(from_c) + e
    state = int(c >= b)
    path = [state]
    for pointers in reversed(back):
        state = pointers[state]
        path.append(state)
    return path[::-1]


def content_words(data: bytes, crf: LineCRF) -> tuple[int, int, int]:
    """(lines with words, content lines, words in content lines)."""
    raw = line_stats(data)
    if not len(raw):
        return 0, 0, 0
    path = np.array(viterbi((features(raw) @ np.array(crf.weights)).tolist(), crf), bool)
    return len(raw), int(path.sum()), int(raw[path, 0].sum())


def _log_likelihood(theta: np.ndarray, x: np.ndarray, y: np.ndarray, at: np.ndarray, t_at: np.ndarray, shape: tuple[int, int],
                    l2: float) -> tuple[float, np.ndarray]:
    """Negative mean log-likelihood and gradient by forward-backward over padded
    sequences; ``at``/``t_at`` place the flat lines into (document, time)."""
    k = x.shape[1]
    w, tr, st = theta[:k], theta[k:k + 4].reshape(2, 2), theta[k + 4:]
    docs, steps = shape
    em = np.zeros((docs, steps, 2))
    em[at, t_at, 1] = x @ w
    mask = np.zeros((docs, steps), bool)
    mask[at, t_at] = True
    alpha = np.zeros((docs, steps, 2))
    alpha[:, 0] = st + em[:, 0]
    for t in range(1, steps):
        step = np.logaddexp(alpha[:, t - 1, 0:1] + tr[0], alpha[:, t - 1, 1:2] + tr[1]) + em[:, t]
        alpha[:, t] = np.where(mask[:, t, None], step, alpha[:, t - 1])
    log_z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
    beta = np.zeros((docs, steps, 2))
    pair = np.zeros((2, 2))
    for t in range(steps - 2, -1, -1):
        nxt = em[:, t + 1] + beta[:, t + 1]
        step = np.stack([np.logaddexp(nxt[:, 0] + tr[i, 0], nxt[:, 1] + tr[i, 1]) for i in (0, 1)], axis=1)
        on = mask[:, t + 1]
        beta[:, t] = np.where(on[:, None], step, beta[:, t + 1])
        joint = alpha[on, t][:, :, None] + tr[None] + nxt[on][:, None, :] - log_z[on][:, None, None]
        pair += np.exp(joint).sum(axis=0)
    p_content = np.exp(alpha[at, t_at, 1] + beta[at, t_at, 1] - log_z[at])
    state = np.zeros((docs, steps), np.int64)
    state[at, t_at] = y
    on = mask[:, 1:]
    seen = np.zeros((2, 2))
    np.add.at(seen, (state[:, :-1][on], state[:, 1:][on]), 1)
    first = state[:, 0]
    p_first = np.exp(alpha[:, 0] + beta[:, 0] - log_z[:, None]).sum(axis=0)
    gold = (x @ w)[y == 1].sum() + (seen * tr).sum() + st[first].sum()
    grad = np.concatenate([x.T @ (p_content - y), (pair - seen).ravel(), p_first - np.bincount(first, minlength=2)]) / docs
    return (log_z.sum() - gold) / docs + l2 * (theta @ theta) / 2, grad + l2 * theta


def fit(sequences: list[tuple[np.ndarray, np.ndarray]], steps: int = 90, rate: float = 0.15, l2: float = 1e-3) -> LineCRF:
    """Maximum conditional likelihood by Adam; ``sequences`` holds (features, states)."""
    sequences = [s for s in sequences if len(s[0])]
    if not sequences or len({int(v) for _, y in sequences for v in np.unique(y)}) < 2:
        return PRIOR
    x = np.concatenate([s[0] for s in sequences])
    y = np.concatenate([s[1] for s in sequences]).astype(np.int64)
    at = np.repeat(np.arange(len(sequences)), [len(s[0]) for s in sequences])
    t_at = np.concatenate([np.arange(len(s[0])) for s in sequences])
    shape = len(sequences), max(len(s[0]) for s in sequences)
    theta = np.zeros(x.shape[1] + 6)
    m = v = np.zeros_like(theta)
    for i in range(1, steps + 1):
        _, g = _log_likelihood(theta, x, y, at, t_at, shape, l2)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta - rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
    k = x.shape[1]
    return LineCRF(tuple(theta[:k].tolist()), tuple(theta[k:k + 4].tolist()), tuple(theta[k + 4:].tolist()))


def train(docs: DataFrame, labels: DataFrame, max_train_docs: int = MAX_TRAIN_DOCS, chain: int = CHAIN) -> LineCRF:
    """Fit on a bounded sample of labelled rows: the ``max_train_docs`` smallest hashes
    of labelled ids (no sort of the table; a top-k), line statistics made on executors."""
    ids = (labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
           .groupBy("doc_id").agg(F.max("quality").alias("quality"))
           .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train_docs))
    # at most max_train_docs rows of two numbers: a proven bound
    sample = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").where(F.col("text").isNotNull())

    def make():
        def step(cols):
            raw = [line_stats(utf8(t)) for t in cols["text"]]
            return {"doc_id": cols["doc_id"], "quality": cols["quality"], "raw": [r.astype("<f4").tobytes() for r in raw]}
        return step

    rows = map_batches(sample, make, "doc_id long, quality int, raw binary").orderBy("doc_id", "raw").limit(2 * max_train_docs).collect()
    sequences = []
    for r in rows:
        raw = np.frombuffer(r.raw, "<f4").reshape(-1, len(RAW)).astype(np.float64)
        y = np.full(len(raw), r.quality) * (raw[:, RAW.index("dup")] == 0)
        x = features(raw)
        sequences += [(x[i:i + chain], y[i:i + chain]) for i in range(0, len(raw), chain)]
    return fit(sequences)


COLUMNS = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
           "base_failed boolean, kept boolean, n_lines long, n_content_lines long, content_share double")


def judge_text(text: str | None, crf: LineCRF, share: float = CONTENT_SHARE) -> tuple:
    data = utf8(text)
    n, chars, symbols, dups, repeats = base_counts(data)
    failed = n < MIN_WORDS or 100 * repeats > 50 * n
    lines, content, words = content_words(data, crf)
    part = words / n if n else 0.0
    return n, chars, symbols, dups, repeats, failed, not failed and part >= share, lines, content, part


def judge(docs: DataFrame, crf: LineCRF, share: float = CONTENT_SHARE) -> DataFrame:
    """One row per document: base counts, line labels in numbers, verdict."""
    prepare(docs.sparkSession)
    names = [f.split()[0] for f in COLUMNS.split(", ")]

    def make():
        def step(cols):
            rows = [judge_text(t, crf, share) for t in cols["text"]]
            return dict(zip(names, [cols["doc_id"], *map(list, zip(*rows))]))
        return step

    return map_batches(docs.select("doc_id", "text"), make, COLUMNS)


def filter_documents(docs: DataFrame, crf: LineCRF, share: float = CONTENT_SHARE) -> DataFrame:
    """The rows whose text is kept, all columns as they came."""
    prepare(docs.sparkSession)

    def run(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            yield batch.filter(pa.array([judge_text(t, crf, share)[6] for t in texts], pa.bool_()))

    at = docs.columns.index("text")
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # a column may have any name, dots in it
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def op1(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    prepare(spark)
    return judge(docs, train(docs, labels))
