"""Benchmark decontamination by a positional inverted index.

Index: the training table is cut into blocks of whole documents; each block stores
every term with the sorted list of its positions (a document's tokens lie one after
the other, documents are ``GAP`` positions apart, so no phrase reaches across). A
block is one row of a Parquet table in the shared folder: the index is distributed by
document, any executor can search any block, a lost one reads it again.

Search: a test item gives its windows of ``window`` words (a shorter item one window
of all its words). Windows are kept by the term that the fewest of them hold, so a block is
searched only for those whose term it has. There, a window takes its rarest term's list, shifts it by the
term's offset, and intersects it with the next rarest list shifted by that term's
offset, and so on; what is left are exact phrase matches. With ``slop`` s > 0 the same
intersection lets each term lie up to s positions off its place, whichever term it
starts from: proximity matches.

Words: A-Z lower-cased, runs of characters outside ASCII punctuation, blanks and
controls. Test items are written to the shared folder in blocks of at most
``ITEM_BLOCK_WINDOWS`` windows and ``ITEM_BLOCK_BYTES`` (a longer item is cut into parts
that share ``window - 1`` words); tasks read a block there and make its windows. The driver
holds the blocks' names and sizes. Blocks are searched one after the other, their matches
written, and the matches of a row merged.

Cases: null or wordless texts have n_words 0 and no hit, but a row. Items without words
match nothing; an item id that repeats counts once; a null item id is an item, counted but not listed.
Repeated rows and null ids of documents are answered row by row. No test items: no hit.
"""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearth.llm.common import free_name, map_batches, open_folder, prepare, stream_batches, utf8
from hearth.session import materialize, scratch_path

WINDOW = 13
SLOP = 2  # of the proximity query
GAP = 64  # more than a window and its slop
BLOCK_TOKENS = 1 << 18
ITEM_BLOCK_BYTES = 32 << 20
ITEM_BLOCK_WINDOWS = 250_000  # some 412 bytes each in a task's memory
#: ASCII letters and digits, lower-cased, and all bytes of other characters; the rest part words.
_FOLD = bytes(c if c >= 128 or chr(c).isdigit() or chr(c).islower() else c + 32 if chr(c).isupper() else 32 for c in range(256))


def words_of(data: bytes) -> list[bytes]:
    return data.translate(_FOLD).split()


# --- index -----------------------------------------------------------------

INDEX = "block string, ids binary, lengths binary, terms binary, counts binary, positions binary, n_tokens long"


def _pack(doc_ids: list, lengths: list[int], codes: list[np.ndarray], terms: list[bytes], block: str) -> dict:
    zip_ = zstandard.ZstdCompressor(level=1).compress
    length = np.array(lengths, np.int64)
    starts = np.concatenate(([0], np.cumsum(length + GAP)[:-1])) if len(length) else length
    code = np.concatenate(codes) if codes else np.zeros(0, np.int32)
    position = np.repeat(starts - np.concatenate(([0], np.cumsum(length)[:-1])), length) + np.arange(len(code))
    order = np.argsort(code, kind="stable")  # positions stay sorted inside a term
    counts = np.bincount(code, minlength=len(terms)).astype("<i4")
    known = np.array([i is not None for i in doc_ids], np.uint8)
    ids = np.array([0 if i is None else i for i in doc_ids], "<i8")
    return {"block": [block], "ids": [zip_(known.tobytes() + ids.tobytes())], "lengths": [zip_(length.astype("<i8").tobytes())],
            "terms": [zip_(b" ".join(terms))], "counts": [zip_(counts.tobytes())],
            "positions": [zip_(position[order].astype("<i8" if len(position) and position[-1] >= 1 << 31 else "<i4").tobytes())],
            "n_tokens": [len(code)]}


def build_index(docs: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Writes the positional index of ``docs(doc_id, text)``: one row per block of whole
    documents with about ``block_tokens`` tokens (a longer document is a block of its
    own). Memory of a task: one block."""

    def run(batches: Iterable[dict[str, list]]) -> Iterator[dict]:
        from pyspark import TaskContext

        task, made = TaskContext.get().partitionId(), 0

        def fresh():
            d: dict[bytes, int] = defaultdict()
            d.default_factory = d.__len__
            return d, [], [], [], 0

        terms, ids, lengths, codes, size = fresh()
        for cols in batches:
            for i, text in zip(cols["doc_id"], cols["text"]):
                words = words_of(utf8(text))
                codes.append(np.fromiter((terms[w] for w in words), np.int32, len(words)))
                ids.append(i)
                lengths.append(len(words))
                size += len(words) + 1
                if size >= block_tokens:
                    yield _pack(ids, lengths, codes, list(terms), f"{task}-{made}")
                    made += 1
                    terms, ids, lengths, codes, size = fresh()
        if ids:
            yield _pack(ids, lengths, codes, list(terms), f"{task}-{made}")

    return materialize(stream_batches(docs.select("doc_id", "text"), run, INDEX), "postings")


class Block:
    """One block of the index, opened for search."""

    def __init__(self, row: dict):
        unzip = zstandard.ZstdDecompressor().decompress
        self.lengths = np.frombuffer(unzip(row["lengths"]), "<i8")
        n = len(self.lengths)
        raw = unzip(row["ids"])
        known = np.frombuffer(raw[:n], np.uint8)
        self.ids = [int(i) if k else None for i, k in zip(np.frombuffer(raw[n:], "<i8"), known)]
        self.starts = np.concatenate(([0], np.cumsum(self.lengths + GAP)[:-1])) if n else self.lengths
        self.terms = {t: i for i, t in enumerate(unzip(row["terms"]).split())}
        self.counts = np.frombuffer(unzip(row["counts"]), "<i4")
        raw = unzip(row["positions"])
        self.positions = np.frombuffer(raw, "<i4" if len(raw) == 4 * row["n_tokens"] else "<i8")
        self.ends = np.cumsum(self.counts, dtype=np.int64)

    def postings(self, code: int) -> np.ndarray:
        end = int(self.ends[code])
        return self.positions[end - int(self.counts[code]):end]

    def find(self, window: tuple[bytes, ...], slop: int = 0) -> np.ndarray:
        """Positions of the block where the window starts; with a slop, where each of its
        terms stands at most ``slop`` off its place."""
        codes = []
        for w in window:
            c = self.terms.get(w)
            if c is None:
                return self.positions[:0]
            codes.append(c)
        rare = sorted(range(len(codes)), key=lambda j: self.counts[codes[j]])
        start = self.postings(codes[rare[0]]).astype(np.int64) - rare[0]
        if slop:
            start = np.unique((start[:, None] + np.arange(-slop, slop + 1)).ravel())
        for j in rare[1:]:
            if not start.size:
                break
            here, want = self.postings(codes[j]), start + j
            at = np.searchsorted(here, want - slop)
            start = start[(at < here.size) & (here[np.minimum(at, here.size - 1)] <= want + slop)]
        return start


def windows_of(words: list[bytes], size: int = WINDOW) -> list[tuple[bytes, ...]]:
    if not words:
        return []
    return [tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1))]


# --- search ----------------------------------------------------------------

MATCHES = ("block string, seq long, doc_id long, n_words long, starts array<long>, ends array<long>, items array<string>, "
           "near_items array<string>")


ITEMS = "item string, words binary, n_windows long, block string"


def write_items(benchmark: DataFrame, window: int = WINDOW) -> str:
    """Writes the words of the test items under a folder for each block; returns its path."""
    most, most_bytes = ITEM_BLOCK_WINDOWS, ITEM_BLOCK_BYTES

    def run(batches: Iterable[dict[str, list]]) -> Iterator[dict]:
        from pyspark import TaskContext

        task, made, n, size = TaskContext.get().partitionId(), 0, 0, 0
        for cols in batches:
            for item, text in zip(cols["item_id"], cols["text"]):
                words = words_of(utf8(text))
                for at in range(0, max(1, len(words) - window + 1) if words else 0, most):
                    part = words[at:at + most + window - 1]
                    own, joined = max(1, len(part) - window + 1), b" ".join(part)
                    if n and (n + own > most or size + len(joined) > most_bytes):
                        made, n, size = made + 1, 0, 0
                    n, size = n + own, size + len(joined)
                    yield {"item": [item], "words": [joined], "n_windows": [own], "block": [f"{task}-{made}"]}

    path = scratch_path(benchmark.sparkSession, "items")
    stream_batches(benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text"), run, ITEMS).write.partitionBy("block").parquet(path)
    return path


def _passes(spark: SparkSession, items: str) -> list[list[str]]:
    """The written blocks by name, small ones (of small files) searched together; one pass at least."""
    sizes = spark.read.schema(ITEMS).parquet(items).groupBy("block").agg(F.sum("n_windows").alias("n"), F.sum(F.length("words")).alias("size"))
    out: list[list[str]] = [[]]
    n = size = 0
    for r in sizes.orderBy("block").toLocalIterator():
        if out[-1] and (n + r.n > ITEM_BLOCK_WINDOWS or size + r.size > ITEM_BLOCK_BYTES):
            out.append([])
            n = size = 0
        out[-1].append(r.block)
        n, size = n + r.n, size + r.size
    return out


def _windows(items: str, blocks: list[str], window: int) -> dict[tuple[bytes, ...], set[str]]:
    """The windows of some written blocks, with the items that have them."""
    from pyarrow import parquet

    wanted: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
    fs, base = open_folder(items)
    for b in blocks:
        cols = parquet.read_table(f"{base}/block={b}", filesystem=fs, partitioning=None, columns=["item", "words"]).to_pydict()
        for item, words in zip(cols["item"], cols["words"]):
            for w in windows_of(words.split(), window):
                wanted[w].add(item)
    return wanted


def by_anchor(wanted: dict[tuple[bytes, ...], set]) -> dict[bytes, list[tuple[tuple[bytes, ...], set]]]:
    """The windows by one term each, the one that the fewest of them hold: a block without it has none of them."""
    held = Counter(t for w in wanted for t in set(w))
    out: dict[bytes, list] = defaultdict(list)
    for w, ids in wanted.items():
        out[min(w, key=lambda t: (held[t], t))].append((w, ids))
    return out


def _listed(ids: Iterable[str | None]) -> list[str | None]:
    return sorted(ids, key=lambda i: (i is None, i or ""))


def _search(items: str, blocks: list[str], window: int, slop: int, finish: Callable[[dict], dict] | None = None, every: bool = True):
    """A task's search of index rows for blocks of test items: a row for each document, or
    only (not ``every``) for those with matches; ``finish`` may turn each block's matches
    into the rows to give."""

    def run(rows: Iterable[dict[str, list]]) -> Iterator[dict]:
        wanted = None
        for cols in rows:
            if wanted is None:
                wanted = by_anchor(_windows(items, blocks, window))
            for i in range(len(cols["block"])):
                block = Block({k: v[i] for k, v in cols.items()})
                n = len(block.ids)
                spans: list[list[tuple[int, int]]] = [[] for _ in range(n)]
                found: list[set[str]] = [set() for _ in range(n)]
                near: list[set[str]] = [set() for _ in range(n)]
                for w, ids in (x for anchor in wanted.keys() & block.terms.keys() for x in wanted[anchor]):
                    for at in block.find(w).tolist():
                        d = int(np.searchsorted(block.starts, at, side="right")) - 1
                        spans[d].append((at - int(block.starts[d]), at - int(block.starts[d]) + len(w)))
                        found[d] |= ids
                    if slop:
                        for at in block.find(w, slop).tolist():
                            # a start may lie before its document; its first term lies inside
                            near[max(0, int(np.searchsorted(block.starts, at + slop, side="right")) - 1)].update(ids)
                out = {"block": [cols["block"][i]] * n, "seq": list(range(n)), "doc_id": block.ids, "n_words": block.lengths.tolist(),
                       "starts": [[a for a, _ in s] for s in spans], "ends": [[b for _, b in s] for s in spans],
                       "items": [_listed(f) for f in found], "near_items": [_listed(x - f) for x, f in zip(near, found)]}
                if not every:
                    hit = [d for d in range(n) if found[d] or near[d]]
                    out = {k: [v[d] for d in hit] for k, v in out.items()}
                yield finish(out) if finish else out

    return run


def search(index: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = 0) -> DataFrame:
    """Matches of every indexed row: the spans (word positions, end exclusive) and ids of
    items with exact windows, and ids of items that only have proximity matches."""
    items = write_items(benchmark, window)
    return _merged(index, items, _passes(index.sparkSession, items), window, slop)


def _merged(index: DataFrame, items: str, passes: list[list[str]], window: int, slop: int) -> DataFrame:
    """The union of the searches of several passes, each written, row by row."""
    if len(passes) == 1:
        return stream_batches(index, _search(items, passes[0], window, slop), MATCHES)
    parts = [materialize(stream_batches(index, _search(items, blocks, window, slop, every=k == 0), MATCHES), "matches") for k, blocks in enumerate(passes)]
    merged = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("items", "near_items")]
    found = reduce(DataFrame.union, parts).groupBy("block", "seq").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
        *[F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "ends")], *merged)
    return found.withColumn("near_items", F.array_except("near_items", "items")).select(*[f.split()[0] for f in MATCHES.split(", ")])


def covered(starts: list[int], ends: list[int]) -> int:
    """Words inside any of the spans."""
    total, reach = 0, 0
    for a, b in sorted(zip(starts, ends)):
        total += max(0, b - max(a, reach))
        reach = max(reach, b)
    return total


REPORT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, n_near_items long, near_items array<string>"


def _reported(c: dict) -> dict:
    """Report rows from matches."""
    hits = [covered(a, b) for a, b in zip(c["starts"], c["ends"])]
    return {"doc_id": c["doc_id"], "n_words": c["n_words"], "n_hit": hits, "n_items": [len(i) for i in c["items"]],
            "items_sha256": [hashlib.sha256(",".join(x for x in i if x is not None).encode()).hexdigest() for i in c["items"]],
            "contaminated": [h > 0 and 20 * h >= n for h, n in zip(hits, c["n_words"])], "n_near_items": [len(i) for i in c["near_items"]],
            "near_items": c["near_items"]}


def report(index: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = 0) -> DataFrame:
    """A row per indexed row: hit words, items, verdict. One pass over the items is searched
    and reported by one worker; several are merged first."""
    items = write_items(benchmark, window)
    passes = _passes(index.sparkSession, items)
    if len(passes) == 1:
        return stream_batches(index, _search(items, passes[0], window, slop, _reported), REPORT)
    return map_batches(_merged(index, items, passes, window, slop), lambda: _reported, REPORT)


def op8(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The exact matches, the columns that SQL can tell; ``op8_near`` adds the items near by."""
    prepare(spark)
    return report(build_index(docs), benchmark).drop("n_near_items", "near_items")


def op8_near(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The columns of ``op8``, and number and sorted ids of the items that a row only holds
    with words up to ``SLOP`` off their places."""
    prepare(spark)
    return report(build_index(docs), benchmark, slop=SLOP)


#: The same result in DuckDB SQL, by a join of word windows.
ORACLE = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bi AS (SELECT item, w, unnest(range(0, greatest(1, len(w) - 12))) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, array_to_string(w[i + 1:i + 13], ' ') AS k, least(len(w), 13) AS n FROM bi),
dw AS (SELECT r, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM bw) x WHERE len(w) >= n),
hit AS (SELECT DISTINCT dw.r, dw.i, dw.n, item FROM dw JOIN bw ON bw.n = dw.n AND array_to_string(w[i + 1:i + dw.n], ' ') = bw.k),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) y GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hit) z GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN its USING (r)
"""


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, all columns as they came. Rows are
    told apart by a 64-bit key of (id, text), so ids may repeat or be null; the few
    contaminated keys are joined away."""
    prepare(docs.sparkSession)
    key = F.xxhash64("doc_id", "text")
    out = report(build_index(docs.select(key.alias("doc_id"), "text")), benchmark).where("contaminated")
    out = materialize(out.select(F.col("doc_id").alias("llm_out")).distinct(), "contaminated")
    name = free_name(docs, "llm_key")
    keyed = docs.withColumn(name, key)
    return keyed.join(out, keyed[name] == out.llm_out, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
