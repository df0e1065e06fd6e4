"""Token counts by a map-side two-tier lookup.

A byte-level tokenizer's text length is the sum over its pre-tokens, each alone. Tier one
is a table of the corpus's frequent pre-tokens with their lengths, packed, broadcast, and
turned into a hash table once per worker; tier two is a bounded cache per worker, in which
a miss of tier one is encoded by the library once. No pre-token is shuffled.

The frequent ones come from all rows: every task keeps a Misra-Gries summary of its
pre-tokens (``SUMMARY`` counters; what it loses, a count of at most rows / ``SUMMARY``,
changes the speed and never a result), and the summaries, one packed row a task, are merged
``FAN_IN`` at a time until one is left. So the table has at most ``SUMMARY`` entries of at most
``MAX_PIECE`` code points, whatever the corpus.

Pre-tokens: texts of Latin code points are split by the tokenizer's public pattern with
letter and digit classes spelled out; other texts by the library's own pre-tokenizer.
Strings of special tokens in a text are one token each, the library's default.

Cases: a null or empty text has 0 bytes and 0 tokens; ids may be null or repeat, each row
is counted; texts are split whole, in portions of ``PORTION`` pre-tokens; pre-tokens over
``MAX_PIECE`` are encoded without being kept. An empty table gives an empty result. The
tokenizer must be byte-level BPE without normalizer, else ``ValueError``.
"""

from __future__ import annotations

import itertools
import json
import re
import struct
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator

import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearth.llm.common import map_batches, prepare, stream_batches
from hearth.session import materialize

SUMMARY = 16_384
FAN_IN = 32
MAX_PIECE = 48
CACHE = 200_000
PORTION = 50_000
LIMIT = 512

#: Code points up to here are split by ``latin_pattern``; letters and digits among them are
#: the same in every version of Unicode that the libraries use.
LATIN_END = 0x24F


def latin_pattern() -> re.Pattern:
    """The public byte-level pattern for Latin code points: contractions, letters, digits and
    other signs, each with an optional blank before it, and white space."""
    kinds = {c: unicodedata.category(chr(c))[0] for c in range(LATIN_END + 1)}

    def chars(kind: str) -> str:
        return "".join(re.escape(chr(c)) for c, k in kinds.items() if k == kind)

    blank = "\\t-\\r \\x85\\xa0"
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{chars('L')}]+| ?[{chars('N')}]+| ?[^{blank}{chars('L')}{chars('N')}]+|[{blank}]+(?![^{blank}])|[{blank}]+")


class Splitter:
    """Pre-tokens of a text, and the strings of special tokens that stand in it."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path) as f:
            made = json.load(f)
        before = made.get("pre_tokenizer") or {}
        if before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or made.get("normalizer"):
            raise ValueError("the tokenizer must be byte-level, without normalizer and added blanks")
        added = made.get("added_tokens", [])
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("added tokens must stand for themselves alone")
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        names = sorted((t["content"] for t in added), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, names))) if names else None
        self.latin = latin_pattern()
        self.beyond = re.compile(f"[^\0-{chr(LATIN_END)}]")

    def portions(self, text: str) -> Iterator[list[str]]:
        """The pre-tokens of a text without special strings, in lists of bounded length."""
        if not self.beyond.search(text):
            if len(text) <= PORTION:
                yield self.latin.findall(text)
                return
            found = (m.group() for m in self.latin.finditer(text))
            while part := list(itertools.islice(found, PORTION)):
                yield part
        else:
            yield [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def plain(self, text: str) -> tuple[int, list[str]]:
        """(special tokens, the texts between them)."""
        if self.special is None or not self.special.search(text):
            return 0, [text]
        between = self.special.split(text)
        return len(between) - 1, between

    def length(self, piece: str) -> int:
        return len(self.library.encode(piece, add_special_tokens=False).ids)


_SPLITTERS: dict[str, Splitter] = {}


def splitter(path: str) -> Splitter:
    """One per worker process and file."""
    if path not in _SPLITTERS:
        _SPLITTERS[path] = Splitter(path)
    return _SPLITTERS[path]


# --- tier one ----------------------------------------------------------------------


def shorten(counts: dict[str, int], most: int) -> dict[str, int]:
    """A Misra-Gries summary of at most ``most`` counters: the count behind the last that
    stays is taken off all."""
    if len(counts) <= most:
        return counts
    off = sorted(counts.values(), reverse=True)[most]
    return {p: n - off for p, n in counts.items() if n > off}


def pack(counts: dict[str, int]) -> bytes:
    """Numbers, then the strings, compressed."""
    keys = [p.encode("utf-8", "surrogatepass") for p in counts]
    n = len(keys)
    raw = struct.pack(f"<I{n}Q{n}H", n, *counts.values(), *map(len, keys)) + b"".join(keys)
    return zstandard.ZstdCompressor(level=3).compress(raw)


def unpack(packed: bytes) -> dict[str, int]:
    raw = zstandard.ZstdDecompressor().decompress(packed)
    n = struct.unpack_from("<I", raw)[0]
    values = struct.unpack_from(f"<{n}Q", raw, 4)
    ends = list(itertools.accumulate(struct.unpack_from(f"<{n}H", raw, 4 + 8 * n), initial=4 + 10 * n))
    return {raw[a:b].decode("utf-8", "surrogatepass"): v for a, b, v in zip(ends, ends[1:], values)}


SUMMARIES = "part long, packed binary"


def summaries(docs: DataFrame, tokenizer: str, most: int = SUMMARY) -> DataFrame:
    """One packed summary per task, over all its rows."""

    def run(batches: Iterable[dict[str, list]]) -> Iterator[dict]:
        from pyspark import TaskContext

        split, counts = splitter(tokenizer), Counter()
        for cols in batches:
            for text in cols["text"]:
                for plain in split.plain(text or "")[1]:
                    for pieces in split.portions(plain):
                        counts.update(pieces)
                        if len(counts) > 8 * most:
                            counts = Counter(shorten({p: n for p, n in counts.items() if len(p) <= MAX_PIECE}, most))
        kept = shorten({p: n for p, n in counts.items() if len(p) <= MAX_PIECE}, most)
        if kept:
            yield {"part": [TaskContext.get().partitionId()], "packed": [pack(kept)]}

    return stream_batches(docs.select("text"), run, SUMMARIES)


def frequent(docs: DataFrame, tokenizer: str, most: int = SUMMARY) -> bytes:
    """The packed table of frequent pre-tokens and their lengths in tokens."""

    def merge(batches: Iterable[dict[str, list]]) -> Iterator[dict]:
        merged: dict[int, Counter] = {}
        for cols in batches:
            for part, packed in zip(cols["part"], cols["packed"]):
                merged[part] = Counter(shorten(merged.get(part, Counter()) + Counter(unpack(packed)), 2 * most))
        for part, counts in merged.items():
            yield {"part": [part], "packed": [pack(shorten(counts, most))]}

    def lengths(batches: Iterable[dict[str, list]]) -> Iterator[dict]:
        split = splitter(tokenizer)
        for cols in merge(batches):
            yield {"part": cols["part"], "packed": [pack({p: split.length(p) for p in unpack(x)}) for x in cols["packed"]]}

    level = materialize(summaries(docs, tokenizer, most), "summaries")
    while (n := level.agg(F.max("part")).first()[0] or 0) >= FAN_IN:
        dealt = level.withColumn("part", F.floor(F.col("part") / FAN_IN)).repartition(n // FAN_IN + 1, "part")
        level = materialize(stream_batches(dealt, merge, SUMMARIES), "summaries")
    last = stream_batches(level.withColumn("part", F.lit(0).cast("long")).coalesce(1), lengths, SUMMARIES).first()
    return bytes(last.packed) if last else pack({})


# --- both tiers --------------------------------------------------------------------


class Lengths(dict):
    """Tier one as a hash table; a miss is looked up, or encoded, in the worker's cache."""

    def __init__(self, table: dict[str, int], split: Splitter, cache: dict[str, int], most: int):
        super().__init__(table)
        self.split, self.cache, self.most = split, cache, most

    def __missing__(self, piece: str) -> int:
        n = self.cache.get(piece)
        if n is None:
            n = self.split.length(piece)
            if len(piece) <= MAX_PIECE:
                if len(self.cache) >= self.most:
                    self.cache.clear()
                self.cache[piece] = n
        return n

    def count(self, text: str | None) -> int:
        """Tokens of a whole text."""
        if not text:
            return 0
        n, between = self.split.plain(text)
        return n + sum(sum(map(self.__getitem__, pieces)) for plain in between for pieces in self.split.portions(plain))


_CACHES: dict[str, dict[str, int]] = {}
#: The hash table of the broadcast that this worker met last.
_TABLE: dict[str, Lengths] = {}

RESULT = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def count(docs: DataFrame, tokenizer: str, limit: int = LIMIT, most: int = SUMMARY, cache: int = CACHE) -> DataFrame:
    """One row per document: bytes, tokens, and whether these are over ``limit``."""
    spark = prepare(docs.sparkSession)
    sent, name = spark.sparkContext.broadcast(frequent(docs, tokenizer, most)), uuid.uuid4().hex

    def make():
        if name not in _TABLE:
            _TABLE.clear()
            _TABLE[name] = Lengths(unpack(sent.value), splitter(tokenizer), _CACHES.setdefault(tokenizer, {}), cache)
        tokens = _TABLE[name].count

        def step(cols):
            n = list(map(tokens, cols["text"]))
            return {"doc_id": cols["doc_id"], "n_bytes": cols["n_bytes"], "n_tokens": n, "over_limit": [x > limit for x in n]}
        return step

    rows = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return map_batches(rows, make, RESULT)


def op11(spark: SparkSession, docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    prepare(spark)
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return count(docs, tokenizer)
