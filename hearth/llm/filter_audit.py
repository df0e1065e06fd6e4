"""Filter interaction audit: what five document filters remove, alone and in every order.

Features come from one table-driven finite-state pass over the UTF-8 bytes of a batch. A
byte has one of five classes; the transducer's state is the class before, and the pair's
entry in one table says what the byte emits: begin or end of a word, code point, capital, symbol.
The state is carried from piece to piece, so long texts are read in pieces; a document's
end is a delimiter. Word spans then go into an open-addressing hash table of (document,
span): a taken slot counts as the same word only when length and all bytes agree.

Filters (each says when a document fails): A under ``MIN_WORDS`` words; B fewer than 65 % of the
words distinct; C over 5 % of the code points are ``[A-Z]``; D a character of ``[#$%&*|]``;
E the text of a smaller doc_id, table-wide. Equal texts are those of equal SHA-256 and
length. The smallest id of each text is found from counts per (text, source, verdicts), so a
text that a third of all rows share is summed before it moves; no document is joined back to its text.

The audit holds, for each part (source), counts by the set of failed filters, 32 at most; all
120 orders follow from these: a filter removes, at its step, the documents that fail
it and none before it.

Cases: a null text is empty (0 words: A fails, B, C and D do not). A null source is the part
"" (as is the empty one). Rows that repeat a doc_id are documents of their own; E compares
with smaller ids only, so equal ids do not fail each other, and a null id neither fails
E nor makes others fail. A document is good (toxic) if any label row of its id has quality
= 1 (toxic = 1); null ids have no labels. An empty table has no parts, so no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from hearth.llm.common import prepare, schema_of
from hearth.session import materialize

FILTERS = "ABCDE"
MIN_WORDS = 50
MIN_DISTINCT = 65
MAX_CAPITALS = 5
PIECE = 1 << 22

# --- the transducer ----------------------------------------------------------------

SPACE, OTHER, CAPITAL, SYMBOL, INNER = range(5)
BEGIN, END, POINT, UPPER, SIGN = 1, 2, 4, 8, 16


def _classes() -> np.ndarray:
    """The class of each byte; bytes 0x80 to 0xBF continue a code point."""
    out = np.full(256, OTHER, np.uint8)
    out[[0x20, *range(0x09, 0x0E)]] = SPACE
    out[0x41:0x5B] = CAPITAL
    out[list(b"#$%&*|")] = SYMBOL
    out[0x80:0xC0] = INNER
    return out


def _emissions() -> np.ndarray:
    """What a byte emits, by 5 * class before + own class."""
    out = np.zeros((5, 5), np.uint8)
    out[SPACE, 1:] |= BEGIN
    out[1:, SPACE] |= END
    out[:, :INNER] |= POINT
    out[:, CAPITAL] |= UPPER
    out[:, SYMBOL] |= SIGN
    return out.ravel()


CLASSES, EMISSIONS = _classes(), _emissions()


def transduce(data: np.ndarray, offsets: np.ndarray, piece: int = PIECE) -> dict[int, np.ndarray]:
    """Places of each emission; document i has the bytes ``offsets[i]`` to ``offsets[i + 1]``. The
    end of a word is the place behind it."""
    found: dict[int, list[np.ndarray]] = {k: [] for k in (BEGIN, END, POINT, UPPER, SIGN)}
    state = SPACE
    borders = offsets[1:-1]
    for lo in range(0, len(data), piece):
        own = CLASSES[data[lo:lo + piece]]
        before = np.empty_like(own)
        before[0], before[1:] = state, own[:-1]
        state = int(own[-1])
        here = borders[np.searchsorted(borders, lo):np.searchsorted(borders, lo + len(own))] - lo
        cut = here[before[here] != SPACE]  # a word that a document's end closes
        before[here] = SPACE
        emitted = EMISSIONS[5 * before + own]
        for kind in (BEGIN, UPPER, SIGN):
            found[kind].append(np.flatnonzero(emitted & kind) + lo)
        found[POINT].append(np.flatnonzero(~emitted & POINT) + lo)  # the rare bytes that begin no code point
        found[END].append(np.union1d(np.flatnonzero(emitted & END), cut) + lo)
    out = {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in found.items()}
    if state != SPACE:
        out[END] = np.append(out[END], len(data))
    return out


# --- the hash table of word spans ------------------------------------------------------

LONG_WORD = 64
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Spans:
    """Words of a batch as (document, start, length), with eight bytes of a word at a time."""

    def __init__(self, data: np.ndarray, doc: np.ndarray, start: np.ndarray, length: np.ndarray):
        padded = np.concatenate((data, np.zeros(8, np.uint8)))
        self.bytes, self.doc, self.start, self.length = data, doc, start, length
        self.eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))

    def chunk(self, i: np.ndarray, k: int) -> np.ndarray:
        """Bytes 8k to 8k + 7 of the words i, zeros behind their ends."""
        left = np.minimum(self.length[i] - 8 * k, 8)
        return self.eight[self.start[i] + 8 * k] & _KEEP[left]

    def word(self, i: int) -> bytes:
        return self.bytes[self.start[i]:self.start[i] + self.length[i]].tobytes()

    def hashes(self) -> np.ndarray:
        h = (self.doc.astype(np.uint64) << np.uint64(32)) ^ self.length.astype(np.uint64)
        active = np.flatnonzero(self.length <= LONG_WORD)
        k = 0
        while len(active):
            x = (h[active] ^ self.chunk(active, k)) * _MIX
            h[active] = x ^ x >> np.uint64(29)
            k += 1
            active = active[self.length[active] > 8 * k]
        for i in np.flatnonzero(self.length > LONG_WORD).tolist():
            h[i] ^= np.uint64(xxhash.xxh64_intdigest(self.word(i)))
        return h * _MIX

    def same(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the words a and b of each place are equal, document and all bytes."""
        ok = (self.doc[a] == self.doc[b]) & (self.length[a] == self.length[b])
        active = np.flatnonzero(ok & (self.length[a] <= LONG_WORD))
        k = 0
        while len(active):
            equal = self.chunk(a[active], k) == self.chunk(b[active], k)
            ok[active[~equal]] = False
            k += 1
            active = active[equal & (self.length[a[active]] > 8 * k)]
        for i in np.flatnonzero(ok & (self.length[a] > LONG_WORD)).tolist():
            ok[i] = self.word(a[i]) == self.word(b[i])
        return ok


def first_places(spans: Spans, bits: int | None = None) -> np.ndarray:
    """One word of each set of equal ones, by inserting all of them. ``bits``: size of the table
    (at least one slot for each word)."""
    n = len(spans.start)
    bits = bits or max(4, (2 * n).bit_length())
    table = np.full(1 << bits, -1, np.int64)
    slot = (spans.hashes() >> np.uint64(64 - bits)).astype(np.int64)
    new = np.zeros(n, bool)
    rest = np.arange(n)
    while len(rest):
        at = slot[rest]
        free = table[at] < 0
        table[at[free]] = rest[free]  # of several, the last stays
        there = table[at]
        won = there == rest
        new[rest[won]] = True
        lost, there = rest[~won], there[~won]
        rest = lost[~spans.same(lost, there)]
        slot[rest] = (slot[rest] + 1) & (len(table) - 1)
    return np.flatnonzero(new)


def measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Counts of each document of a batch."""
    found = transduce(data, offsets)

    def per_doc(places: np.ndarray) -> np.ndarray:
        return np.diff(np.searchsorted(places, offsets))

    start = found[BEGIN]
    words = per_doc(start)
    doc = np.repeat(np.arange(len(words)), words)
    new = first_places(Spans(data, doc, start, found[END] - start))
    return {"n_words": words, "n_distinct": np.bincount(doc[new], minlength=len(words)), "n_capitals": per_doc(found[UPPER]),
            "n_points": np.diff(offsets) - per_doc(found[POINT]), "n_symbols": per_doc(found[SIGN])}


FEATURES = "doc_id long, part string, n_words long, n_distinct long, n_capitals long, n_points long, n_symbols long, digest binary"


def features(docs: DataFrame) -> DataFrame:
    """One row per document: its id and part, the transducer's counts, and the SHA-256 and length of its text."""
    schema = schema_of(FEATURES)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            text = pc.fill_null(batch.column("text").cast(pa.large_string()), "")
            _, offsets, content = text.buffers()
            offsets = np.frombuffer(offsets, np.int64, len(text) + 1, 8 * text.offset)
            lo = offsets[0]
            data = np.frombuffer(content, np.uint8)[lo:offsets[-1]] if content else np.zeros(0, np.uint8)
            offsets = offsets - lo
            ends = offsets.tolist()
            digest = [hashlib.sha256(data[a:b]).digest() + (b - a).to_bytes(8, "big") for a, b in zip(ends, ends[1:])]
            cols = {"doc_id": batch.column("doc_id"), "part": pc.fill_null(batch.column("source"), "")} | measure(data, offsets) | {"digest": digest}
            yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) if not isinstance(cols[f.name], pa.Array) else cols[f.name].cast(f.type) for f in arrow], schema=arrow)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text").mapInArrow(run, schema)


# --- verdicts and the audit ----------------------------------------------------------


def own_verdicts() -> Column:
    """Bits of the filters A to D that a document of ``features`` fails."""
    fails = (F.col("n_words") < MIN_WORDS, 100 * F.col("n_distinct") < MIN_DISTINCT * F.col("n_words"),
             100 * F.col("n_capitals") > MAX_CAPITALS * F.col("n_points"), F.col("n_symbols") > 0)
    return sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0)).cast("int")


def failed_sets(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, fails, n, good, toxic): documents by the set of filters they fail (bit k: the k-th of
    ``FILTERS``), and how many of them are labelled good and toxic."""
    spots = 16
    rows = features(docs).select("doc_id", "part", "digest", own_verdicts().alias("fails"))
    # rows without an id meet no label: they are spread over keys of their own
    rows = rows.withColumn("spread", F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("digest", "part"), F.lit(4096)) + 1).otherwise(0))
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("label_id"), F.lit(0).cast("long").alias("label_spread")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    rows = rows.join(marks, (rows.doc_id == marks.label_id) & (rows.spread == marks.label_spread), "left")
    group = ["digest", "part", "fails", "good", "toxic"]
    rows = rows.select("doc_id", *group[:3], *[F.coalesce(c, F.lit(False)).alias(c) for c in group[3:]])
    # rows of one id first, then of one text, summed before they move; a text's copies are dealt over some spots first
    by_id = rows.groupBy("doc_id", *group).agg(F.count("*").alias("n"))
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    some = by_id.groupBy(*group, F.pmod(F.xxhash64("doc_id"), F.lit(spots)).alias("spot")).agg(F.sum("n").alias("n"), least.alias("least"),
                                                                                    F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("unknown"))
    texts = materialize(some.groupBy(*group).agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.sum("unknown").alias("unknown")), "texts")
    lowest = texts.groupBy(F.col("digest").alias("low_digest")).agg(F.min("least.doc_id").alias("lowest"))
    met = texts.join(lowest, texts.digest == lowest.low_digest)
    first = F.col("unknown") + F.when(F.col("least.doc_id") == F.col("lowest"), F.col("least.n")).otherwise(0)
    both = F.array(F.struct(F.col("fails").alias("set"), first.alias("rows")),
                   F.struct((F.col("fails") + (1 << 4)).alias("set"), (F.col("n") - first).alias("rows")))
    parted = met.select("part", "good", "toxic", F.inline(both)).where("rows > 0")
    return parted.groupBy("part", F.col("set").alias("fails")).agg(
        F.sum("rows").alias("n"), F.sum(F.when(F.col("good"), F.col("rows")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("rows")).otherwise(0)).alias("toxic"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row per part, order and step: see the module's text and the contract's columns."""
    prepare(docs.sparkSession)
    orders = ["".join(p) for p in permutations(FILTERS)]
    # a part has at most 32 sets
    parts = failed_sets(docs, labels).groupBy("part").agg(F.collect_list(F.struct("fails", "n", "good", "toxic")).alias("sets"))
    rows = parts.withColumn("filter_order", F.explode(F.lit(orders))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))

    def bits(letters: Column) -> Column:
        return sum((F.when(F.contains(letters, F.lit(c)), 1 << k).otherwise(0) for k, c in enumerate(FILTERS)), F.lit(0))

    rows = rows.withColumn("own", bits(F.substring("filter_order", F.col("step"), F.lit(1)))).withColumn("before", bits(F.substring("filter_order", F.lit(1), F.col("step") - 1)))
    total = len(orders)

    def summed(value) -> Column:
        return F.aggregate("sets", F.lit(0).cast("long"), lambda at, s: at + value(s).cast("long"))

    def where(test, name: str) -> Column:
        return summed(lambda s: F.when(test(s["fails"]), s[name]).otherwise(0))

    fails = lambda f: f.bitwiseAND(F.col("own")) != 0
    early = lambda f: f.bitwiseAND(F.col("before")) != 0
    here = lambda f: fails(f) & ~early(f)
    # of the orders, one in as many as a document has failures puts this filter first among them
    share = lambda s: F.when(fails(s["fails"]), s["n"] * (F.lit(total) / F.bit_count(s["fails"]))).otherwise(0)
    return rows.select(
        "part", "filter_order", "step",
        where(lambda f: f.bitwiseAND(F.col("before").bitwiseOR(F.col("own"))) == 0, "n").alias("kept"),
        where(here, "n").alias("removed"), where(lambda f: fails(f) & early(f), "n").alias("redundant"),
        where(lambda f: f == F.col("own"), "n").alias("unique_fails"), where(here, "good").alias("good_lost"),
        where(here, "toxic").alias("toxic_lost"), summed(share).alias("shapley"))


def op12(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    prepare(spark)
    return audit(docs, labels)


#: The same result in DuckDB SQL, order by order over all documents' verdicts.
ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM t),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
v AS (SELECT w.doc_id, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
      CASE WHEN len(words) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 'B' ELSE '' END
      || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN 'C' ELSE '' END
      || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
      || CASE WHEN w.doc_id > min(w.doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END AS failed
      FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
f(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM f a, f b, f c, f d, f e
      WHERE a.x NOT IN (b.x, c.x, d.x, e.x) AND b.x NOT IN (c.x, d.x, e.x) AND c.x NOT IN (d.x, e.x) AND d.x <> e.x),
g AS (SELECT part, failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM v GROUP BY part, failed),
r AS (SELECT part, filter_order, step, filter_order[step] AS x, failed, n, good, toxic,
      contains(failed, filter_order[step]) AS fails, translate(failed, filter_order[1:step - 1], '') <> failed AS early
      FROM g, o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
s AS (SELECT part, filter_order, step, any_value(x) AS x, sum(CASE WHEN NOT fails AND NOT early THEN n ELSE 0 END) AS kept,
      sum(CASE WHEN fails AND NOT early THEN n ELSE 0 END) AS removed, sum(CASE WHEN fails AND early THEN n ELSE 0 END) AS redundant,
      sum(CASE WHEN failed = x THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN fails AND NOT early THEN good ELSE 0 END) AS good_lost,
      sum(CASE WHEN fails AND NOT early THEN toxic ELSE 0 END) AS toxic_lost FROM r GROUP BY part, filter_order, step)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM s
"""
