"""Line dedup with two Bloom filters, for line hashes seen once and seen twice.

Pass 1 reads the lines and writes their 64-bit hashes, packed and distinct per task, by
segment (the hash's top bits). One task per segment holds both filters of that segment,
sized by its own count: a hash whose bits are all in "once" goes into "twice". So a key
that two documents hold is always in "twice"; other keys get in by chance only.
Pass 2 tests every line against "twice". Only suspected repeats are shuffled, as
(key, document): they are counted exactly, and the key's largest doc_id is chosen.
Pass 3 drops the lines. Only texts that lose a line move to meet their drop list; a filter
over these rows, made the same way, lets all other texts be settled where they are read.

Keys: the line without ``[\\x20\\x09-\\x0D]`` at both ends, A-Z lower-cased; keys of at
least ``min_chars`` code points count. Confirmed keys are held in at least ``min_docs``
documents and lose all their lines but those in the largest doc_id holding them.

Size: a segment's filters have ``BITS_PER_LINE`` bits for each of its lines (at most
``MAX_SEGMENT_BITS``). What is sent to the tasks is "twice" alone, folded in half as long as
it stays sparse, so it follows the number of repeated lines, and at most ``2 ** max_log2_bits``
bits in all (64 MB; never under 8 bytes a segment). Beyond that it is folded further and
lets more lines through to the exact count, never fewer (at worst every line is shuffled once,
as a plain count would).
A very common line is one hash a task in pass 1; its documents are counted by partial
sums and its drop list is joined over ``SALTS`` salts. A drop list belongs to one row's content
(id and text, by a 128-bit hash), so it is no longer than the text.

Cases: a null or empty text is one empty line. Rows that repeat a doc_id are one
document in the counts; each row is cut. All null ids count as one document, below every
other id. Empty tables give empty results. Texts of any length are cut whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearth.llm.common import map_batches, prepare, stream_batches, utf8
from hearth.session import materialize

MIN_CHARS = 40
MIN_DOCS = 5
BITS_PER_LINE = 12
PROBES = 3
#: A filter is folded while at most this share of its bits is set.
FILL = 0.25
MAX_LOG2_BITS = 29
SEGMENT_BITS = 12
SEGMENTS = 1 << SEGMENT_BITS
MAX_SEGMENT_BITS = 1 << 31
MIN_SEGMENT_BITS = 64
#: Hashes that a task of pass 1 holds before it writes them.
FLUSH = 1 << 20
SALTS = 16


def key_of(line: bytes) -> bytes:
    return line.strip().lower()


def counted(key: bytes, min_chars: int) -> bool:
    """At least ``min_chars`` code points."""
    return len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode("utf-8", "surrogatepass")) >= min_chars)


def keys_of(text: str | None, min_chars: int) -> set[bytes]:
    """Distinct counted keys of a text."""
    return {k for k in map(key_of, utf8(text).split(b"\n")) if counted(k, min_chars)}


def row_of(doc_id: int | None, text: str | None) -> bytes:
    """A 128-bit key of a row's id and text."""
    return xxhash.xxh3_128_digest(b"%s:%s" % (str(doc_id).encode(), utf8(text)))


def segment_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SEGMENT_BITS)).astype(np.int64)


def probes(hashes: np.ndarray, bits: int | np.ndarray) -> np.ndarray:
    """(n, PROBES) bit places of 64-bit hashes in filters of ``bits`` bits, a power of two (one
    number, or one for each hash). A place in a folded filter is the place modulo its size."""
    low = np.uint64(0xFFFFFFFF)
    a, b = hashes & low, hashes >> np.uint64(20) & low | np.uint64(1)
    last = np.asarray(bits, np.uint64).reshape(-1, 1) - np.uint64(1)
    return a[:, None] + np.arange(PROBES, dtype=np.uint64) * b[:, None] & last


def hashes_of(keys: Iterable[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(k, 7) for k in keys), np.uint64)


def row_hashes(rows: Iterable[bytes]) -> np.ndarray:
    """The first eight bytes of row keys."""
    return np.frombuffer(b"".join(r[:8] for r in rows), ">u8").astype(np.uint64)


class TwoFilters:
    """Once-seen and twice-seen bit arrays (packed) of one segment."""

    def __init__(self, bits: int):
        self.bits = bits
        self.once = np.zeros(bits // 8, np.uint8)
        self.twice = np.zeros(bits // 8, np.uint8)

    def add(self, hashes: np.ndarray, twice: np.ndarray = np.zeros(0, np.uint64)) -> None:
        """Adds keys; repeats inside ``hashes`` and all of ``twice`` count as seen twice."""
        distinct, n = np.unique(hashes, return_counts=True)
        at = probes(distinct, self.bits)
        again = holds(self.once, at) | (n > 1)
        _set(self.twice, at[again])
        _set(self.twice, probes(twice, self.bits))
        _set(self.once, at)


def holds(packed: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which rows of bit places are all set."""
    return (packed[at >> np.uint64(3)] >> (7 - (at & np.uint64(7))).astype(np.uint8) & 1).all(axis=1)


def _set(packed: np.ndarray, at: np.ndarray) -> None:
    np.bitwise_or.at(packed, (at >> np.uint64(3)).ravel(), (np.uint8(128) >> (at & np.uint64(7)).astype(np.uint8)).ravel())


def fold(packed: np.ndarray, fill: float = FILL, times: int = 64) -> np.ndarray:
    """The filter folded in half, at most ``times``, as long as at most ``fill`` of its bits are set."""
    while times > 0 and 8 * len(packed) > MIN_SEGMENT_BITS:
        half = packed[:len(packed) // 2] | packed[len(packed) // 2:]
        if np.bitwise_count(half).sum() > fill * 8 * len(half):
            break
        packed, times = half, times - 1
    return packed


@dataclass
class SeenTwice:
    """The twice-seen filters of all segments in one array: where each starts, and its size, in bits."""
    start: np.ndarray
    bits: np.ndarray
    packed: np.ndarray

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        s = segment_of(hashes)
        return holds(self.packed, self.start[s][:, None] + probes(hashes, self.bits[s]))


def packed_hashes(rows: DataFrame, hashes: Callable[[dict[str, list]], np.ndarray], known: bool = False) -> DataFrame:
    """(segment, n, hashes, twice): distinct hashes of the rows by segment and task, written, and
    those of them that the task met twice (all, if ``known``)."""

    def flush(held: list[np.ndarray]) -> dict:
        distinct, n = np.unique(np.concatenate(held), return_counts=True)
        again = (n > 1) | known
        segments, starts = np.unique(segment_of(distinct), return_index=True)
        ends = [*starts[1:], len(distinct)]
        return {"segment": segments.tolist(), "n": [int(e - s) for s, e in zip(starts, ends)],
                "hashes": [distinct[s:e].tobytes() for s, e in zip(starts, ends)],
                "twice": [distinct[s:e][again[s:e]].tobytes() for s, e in zip(starts, ends)]}

    def run(batches: Iterable[dict[str, list]]) -> Iterator[dict]:
        held: list[np.ndarray] = []
        for cols in batches:
            held.append(hashes(cols))
            if sum(map(len, held)) >= FLUSH:
                yield flush(held)
                held = []
        if sum(map(len, held)):
            yield flush(held)

    return materialize(stream_batches(rows, run, "segment int, n long, hashes binary, twice binary"), "hashes")


def seen_twice(hashes: DataFrame, max_log2_bits: int = MAX_LOG2_BITS) -> SeenTwice:
    """The twice-seen filter over ``packed_hashes``: a task fills one segment after the other."""
    lines = {r.segment: r.lines for r in hashes.groupBy("segment").agg(F.sum("n").alias("lines")).collect()}  # at most SEGMENTS

    def fill(batches: Iterable[dict[str, list]]) -> Iterator[dict]:
        segment, filters = None, None
        for cols in batches:
            for s, seen, twice in zip(cols["segment"], cols["hashes"], cols["twice"]):
                if s != segment:
                    if filters is not None:
                        yield {"segment": [segment], "twice": [fold(filters.twice).tobytes()]}
                    bits = 1 << (lines[s] * BITS_PER_LINE - 1).bit_length()
                    segment, filters = s, TwoFilters(min(MAX_SEGMENT_BITS, max(MIN_SEGMENT_BITS, bits)))
                filters.add(np.frombuffer(seen, np.uint64), np.frombuffer(twice, np.uint64))
        if filters is not None:
            yield {"segment": [segment], "twice": [fold(filters.twice).tobytes()]}

    by_segment = hashes.select("segment", "hashes", "twice").repartition("segment").sortWithinPartitions("segment")
    filters = materialize(stream_batches(by_segment, fill, "segment int, twice binary"), "seen-twice")
    size = 8 * (filters.agg(F.sum(F.length("twice"))).first()[0] or 0)
    spare = max(0, (size - 1).bit_length() - max_log2_bits)

    def make():
        def step(cols):
            return {"segment": cols["segment"], "twice": [fold(np.frombuffer(x, np.uint8), 1.0, spare).tobytes() for x in cols["twice"]]}
        return step

    # a segment without lines points to the empty filter in front
    start, bits = np.zeros(SEGMENTS, np.uint64), np.full(SEGMENTS, MIN_SEGMENT_BITS, np.uint64)
    parts, end = [bytes(MIN_SEGMENT_BITS // 8)], MIN_SEGMENT_BITS
    for row in map_batches(filters, make, "segment int, twice binary").toLocalIterator():
        start[row.segment], bits[row.segment] = end, 8 * len(row.twice)
        parts.append(bytes(row.twice))
        end += 8 * len(row.twice)
    return SeenTwice(start, bits, np.frombuffer(b"".join(parts), np.uint8))


def twice_filter(docs: DataFrame, min_chars: int = MIN_CHARS, max_log2_bits: int = MAX_LOG2_BITS) -> SeenTwice:
    """The twice-seen filter over the lines of a table."""
    return seen_twice(packed_hashes(docs.select("text"), lambda cols: hashes_of(k for t in cols["text"] for k in keys_of(t, min_chars))),
                      max_log2_bits)


def suspects(docs: DataFrame, twice: SeenTwice, min_chars: int = MIN_CHARS) -> DataFrame:
    """(key, doc_id, row) of the lines whose hash the twice-seen filter holds."""
    sent = docs.sparkSession.sparkContext.broadcast(twice)

    def make():
        filters = sent.value

        def step(cols):
            keys: list[bytes] = []
            of: list[int] = []
            for j, t in enumerate(cols["text"]):
                own = keys_of(t, min_chars)
                keys.extend(own)
                of.extend([j] * len(own))
            hit = np.flatnonzero(filters.holds(hashes_of(keys))).tolist()
            rows = {j: row_of(cols["doc_id"][j], cols["text"][j]) for j in {of[x] for x in hit}}
            return {"key": [keys[x] for x in hit], "doc_id": [cols["doc_id"][of[x]] for x in hit], "row": [rows[of[x]] for x in hit]}
        return step

    return map_batches(docs.select("doc_id", "text"), make, "key binary, doc_id long, row binary")


def drop_lists(found: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(row, keys): the confirmed keys that each row loses."""
    found = materialize(found.distinct(), "suspects")
    # an id that is null is one document below all others
    lowest = F.lit(-(1 << 63))
    n = F.count_distinct("doc_id") + F.max(F.col("doc_id").isNull().cast("long"))
    held = found.groupBy("key").agg(n.alias("n"), F.max(F.coalesce("doc_id", lowest)).alias("last"))
    held = held.where(F.col("n") >= min_docs).select("key", "last", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])).alias("salt"))
    salted = found.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
    lost = salted.join(held, ["key", "salt"]).where(F.coalesce("doc_id", lowest) != F.col("last"))
    return lost.groupBy("row").agg(F.collect_list("key").alias("keys"))


RESULT = "doc_id long, n_lines long, n_dropped long, kept_sha256 string"


def cut(data: bytes, lost: set[bytes]) -> tuple[int, int, bytes]:
    """(lines, dropped lines, the other lines joined)."""
    lines = data.split(b"\n")
    if not lost:
        return len(lines), 0, data
    kept = [x for x in lines if key_of(x) not in lost]
    return len(lines), len(lines) - len(kept), b"\n".join(kept)


def _cut_rows(docs: DataFrame, kept: Callable[[bytes], str], ddl: str, min_chars: int, min_docs: int, max_log2_bits: int) -> DataFrame:
    """Every row without its dropped lines: id, line counts and what ``kept`` makes of the other lines."""
    spark = prepare(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    name = ddl.split(", ")[-1].split()[0]
    lists = materialize(drop_lists(suspects(docs, twice_filter(docs, min_chars, max_log2_bits), min_chars), min_docs), "drop-lists")
    losing = seen_twice(packed_hashes(lists.select("row"), lambda cols: row_hashes(cols["row"]), known=True), max_log2_bits)
    sent = spark.sparkContext.broadcast(losing)

    def result(ids, texts, lost):
        rows = [cut(utf8(t), k) for t, k in zip(texts, lost)]
        return {"doc_id": ids, "n_lines": [r[0] for r in rows], "n_dropped": [r[1] for r in rows], name: [kept(r[2]) for r in rows]}

    def settled():
        def step(cols):
            rows = [row_of(i, t) for i, t in zip(cols["doc_id"], cols["text"])]
            out = np.flatnonzero(~sent.value.holds(row_hashes(rows))).tolist()
            return result([cols["doc_id"][x] for x in out], [cols["text"][x] for x in out], [set()] * len(out))
        return step

    def moving():
        def step(cols):
            rows = [row_of(i, t) for i, t in zip(cols["doc_id"], cols["text"])]
            out = np.flatnonzero(sent.value.holds(row_hashes(rows))).tolist()
            return {"doc_id": [cols["doc_id"][x] for x in out], "text": [cols["text"][x] for x in out], "row": [rows[x] for x in out]}
        return step

    def cutting():
        return lambda cols: result(cols["doc_id"], cols["text"], [set(k or ()) for k in cols["keys"]])

    moved = map_batches(docs, moving, "doc_id long, text string, row binary").join(lists, "row", "left")
    return map_batches(docs, settled, ddl).unionByName(map_batches(moved.select("doc_id", "text", "keys"), cutting, ddl))


def dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, max_log2_bits: int = MAX_LOG2_BITS) -> DataFrame:
    """``docs(doc_id, text)`` -> doc_id and text without the dropped lines, n_lines, n_dropped."""
    out = _cut_rows(docs, lambda data: data.decode("utf-8", "surrogatepass"), "doc_id long, n_lines long, n_dropped long, text string",
                    min_chars, min_docs, max_log2_bits)
    return out.select("doc_id", "text", "n_lines", "n_dropped")


def digest(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, max_log2_bits: int = MAX_LOG2_BITS) -> DataFrame:
    """As ``dedup``, with the SHA-256 of the kept text in its place."""
    return _cut_rows(docs, lambda data: hashlib.sha256(data).hexdigest(), RESULT, min_chars, min_docs, max_log2_bits)


def op7(spark: SparkSession, docs: DataFrame) -> DataFrame:
    prepare(spark)
    return digest(docs)


#: The same result in DuckDB SQL, by a plain count of keys.
ORACLE = r"""
WITH t AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, r, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM t),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
h AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, h.key IS NOT NULL AND k.doc_id <> h.last AS dropped FROM k LEFT JOIN h ON k.key = h.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id, r
"""
