"""Spelling variant grouping by dense prefix-suffix tiling.

Two words are near if one inserted, deleted or replaced code point turns one into the other:
their common prefix and their common suffix together reach the longer one's length minus one.
Words that may be near are laid into padded code-point matrices, and blocks of them are
compared pair by pair: column after column for the prefixes, from the right for the suffixes.

Which words meet. Cut the places 0..L of a word of length L into ranges. Two near words,
the shorter of length L, differ at the place where their common prefix ends; outside the
range of that place they agree (the longer one shifted by one). So a group is (L, range,
the agreeing rest): words of length L and words of length L + 1 in the same group are
compared, and a pair counts only in the range that holds the end of its common prefix,
so it counts once. Every word starts with two halves; a group of over ``GROUP`` words is
halved again, down to ranges of one place, where the rest fixes all but one code point, or
two (a group has at most as many words as pairs of letters of the alphabet). Groups are sized by
partial counts before any moves, and none over ``GROUP`` is gathered before that last level.

A tile emits, per word, the number of its near words and the best of them, never pairs.

Cases: a null text has no words, a null id is written as the empty text in ``<doc_id>:<word>``;
rows that repeat count as often as they occur; words of any length are read whole; ties among
near words go to the smallest in code-point order. Empty tables give empty results.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearth.llm.common import prepare, stream_batches
from hearth.session import materialize

MIN_LENGTH = 7
MIN_COUNT = 2
TIMES = 10
DROP_EVERY = 31
LETTERS = "A-Za-zÀ-ÿ"
#: Words of a group that are compared at once; larger groups are cut finer.
GROUP = 384
#: Distinct words that a task sums before it hands them on.
HELD = 200_000
#: Rows whose groups a task compares together, and cells of one tile.
ROWS, CELLS = 40_000, 1 << 21

_LOWER = {c: c + 32 for c in range(65, 91)}

# --- words ---------------------------------------------------------------------------


def altered(doc_id: int | None, run: str) -> str:
    """A lower-cased run as it counts: one in ``DROP_EVERY`` loses a code point."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % DROP_EVERY:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def words(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): the distinct words of all texts and how often they occur."""

    def run(batches: Iterable[dict[str, list]]) -> Iterator[dict]:
        runs = re.compile(f"[{LETTERS}]{{{min_length},}}")  # shorter runs give no word: deleting only shortens
        counts: Counter = Counter()
        for cols in batches:
            for i, text in zip(cols["doc_id"], cols["text"]):
                if not text:
                    continue
                for w, n in Counter(runs.findall(text.translate(_LOWER))).items():
                    w = altered(i, w)
                    if len(w) >= min_length:
                        counts[w] += n
            if len(counts) > HELD:
                yield {"word": list(counts), "n": list(counts.values())}
                counts.clear()
        if counts:
            yield {"word": list(counts), "n": list(counts.values())}

    parts = stream_batches(docs.select("doc_id", "text"), run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


# --- groups ----------------------------------------------------------------------------


def _members(size: Column, lo: Column, hi: Column) -> Column:
    """A group's row for a word: the shorter length, the range, what stands outside it, what stands inside."""
    word, length = F.col("word"), F.length("word")
    behind = length - size + hi  # the range's end in this word
    return F.struct(size.alias("size"), lo.alias("lo"), hi.alias("hi"),
                    F.concat(F.substring(word, F.lit(1), lo), F.substring(word, behind + 1, length)).alias("rest"),
                    F.substring(word, lo + 1, behind - lo).alias("inside"))


def _key() -> Column:
    return F.xxhash64("size", "lo", "hi", "rest")


def halves(vocabulary: DataFrame, min_length: int) -> DataFrame:
    """Every word in the two halves of its length, and in those of the length below."""
    length = F.length("word")
    out = []
    for size in (length, length - 1):
        mid = (size / 2).cast("int")
        out += [F.when(size >= min_length, _members(size, F.lit(0), mid)), F.when(size >= min_length, _members(size, mid, size))]
    rows = vocabulary.select("n", F.explode(F.array_compact(F.array(*out))).alias("g")).select("g.*", "n")
    return rows.withColumn("key", _key())


def finer(rows: DataFrame) -> DataFrame:
    """Members of groups, each in the two halves of the group's range."""
    lo, hi = F.col("lo"), F.col("hi")
    mid = ((lo + hi) / 2).cast("int")
    shift = F.length("inside") - (hi - lo)  # 1 for a longer word

    def part(a: Column, b: Column) -> Column:
        inside = F.substring("inside", a - lo + 1, b - a + shift)
        left, right = F.substring("inside", F.lit(1), a - lo), F.substring("inside", b - lo + shift + 1, F.length("inside"))
        rest = F.concat(F.substring("rest", F.lit(1), lo), left, right, F.substring("rest", lo + 1, F.length("rest")))
        return F.struct("size", a.alias("lo"), b.alias("hi"), rest.alias("rest"), inside.alias("inside"))

    halved = rows.select("n", F.explode(F.array(part(lo, mid), part(mid, hi))).alias("g")).select("g.*", "n")
    return halved.withColumn("key", _key())


# --- tiles -------------------------------------------------------------------------------


def matrix(texts: list[str], width: int, right: bool) -> np.ndarray:
    """Padded code-point matrix against the left or the right edge: a column per text."""
    padded = "".join([t.rjust(width, "\0") for t in texts] if right else [t.ljust(width, "\0") for t in texts])
    points = np.frombuffer(padded.encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(texts), width)
    return np.ascontiguousarray((points.astype(np.uint8) if points.max(initial=0) < 256 else points).T)


def common(a: np.ndarray, b: np.ndarray, places: Iterable[int]) -> np.ndarray:
    """In how many places from the first on the rows of blocks a and b agree, each of a with each
    of b: both are (width, groups, rows), the result is (groups, rows of a, rows of b)."""
    run = np.ones((a.shape[1], a.shape[2], b.shape[2]), bool)
    out = np.zeros(run.shape, np.int16 if len(a) < 1 << 15 else np.int64)
    for k in places:
        run &= a[k][:, :, None] == b[k][:, None, :]
        if not run.any():
            break
        out += run
    return out


def _class(n: np.ndarray) -> np.ndarray:
    """The power of two (at least) that holds n rows; 0 for none."""
    return np.where(n > 0, 1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64), 0)


class Tiles:
    """Compares the groups of a batch of rows, sorted by group, then shorter words before longer
    ones, then n downwards, then by word. Groups of like size and width are stacked."""

    def __init__(self, group: np.ndarray, size: np.ndarray, lo: np.ndarray, hi: np.ndarray, inside: list[str]):
        self.m, self.last, self.inside = hi - lo, hi == size, inside
        longer = np.fromiter(map(len, inside), np.int64, len(inside)) > self.m
        self.starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        self.longs = np.add.reduceat(longer.astype(np.int64), self.starts)
        self.shorts = np.diff(np.append(self.starts, len(group))) - self.longs
        self.near = np.zeros((2, len(group)), np.int64)  # near words among the shorter, the longer ones of the group
        self.best = np.full((2, len(group)), -1, np.int64)  # ... and the first row among them

    def run(self) -> "Tiles":
        classes = np.stack((_class(self.shorts), _class(self.longs), _class(self.m[self.starts])))
        meet = (self.shorts > 0) & (self.shorts + self.longs > 1)
        for wide in np.unique(classes[2][meet]).tolist():
            of_width = meet & (classes[2] == wide)
            rows = np.flatnonzero(np.repeat(of_width, self.shorts + self.longs))
            place = np.zeros(len(self.m), np.int64)
            place[rows] = np.arange(len(rows))
            width = int(self.m[rows].max()) + 1
            texts = [self.inside[r] for r in rows.tolist()]
            self.left, self.right, self.place = matrix(texts, width, False), matrix(texts, width, True), place
            for a, b in np.unique(classes[:2, of_width], axis=1).T.tolist():
                groups = np.flatnonzero(of_width & (classes[0] == a) & (classes[1] == b))
                if a > 1:
                    self._pairs_of_blocks(groups, 0, a, a)
                if b:
                    self._pairs_of_blocks(groups, 1, a, b)
        return self

    def _pairs_of_blocks(self, groups: np.ndarray, kind: int, a: int, b: int) -> None:
        """Compares the shorter words with the shorter (kind 0) or the longer ones (1), block by block."""
        rows_a, rows_b = min(a, 1024), min(b, 1024)
        step = max(1, CELLS // (rows_a * rows_b))
        for i in range(0, len(groups), step):
            for x in range(0, a, rows_a):
                for y in range(0, b, rows_b):
                    self._tile(groups[i:i + step], kind, np.arange(x, x + rows_a), np.arange(y, y + rows_b))

    def _tile(self, groups: np.ndarray, kind: int, at_a: np.ndarray, at_b: np.ndarray) -> None:
        start, shorts = self.starts[groups][:, None], self.shorts[groups][:, None]
        has_a, has_b = at_a < shorts, at_b < (self.longs[groups][:, None] if kind else shorts)
        a = np.where(has_a, start + at_a, start)  # empty places show the group's first row and are masked below
        b = np.where(has_b, start + at_b + (shorts if kind else 0), start)
        most = self.m[start][:, :, None]
        width, i, j = len(self.left), self.place[a], self.place[b]
        prefix = np.minimum(common(self.left[:, i], self.left[:, j], range(width)), most)
        suffix = np.minimum(common(self.right[:, i], self.right[:, j], reversed(range(width))), most)
        near = prefix + suffix >= most - (1 - kind)
        # the common prefix ends in this range; behind its last place only where the word ends
        near &= (prefix < most) | (self.last[start][:, :, None] if kind else False)
        near &= has_a[:, :, None] & has_b[:, None, :]
        self._note(kind, a, b, near)
        if kind:
            self._note(0, b, a, near.transpose(0, 2, 1))

    def _note(self, kind: int, rows: np.ndarray, others: np.ndarray, near: np.ndarray) -> None:
        """Counts, and the first near row: rows stand in order of preference."""
        counts = near.sum(axis=2)
        hit = counts > 0
        at = rows[hit]
        first = np.take_along_axis(others, near.argmax(axis=2), axis=1)[hit]
        self.near[kind, at] += counts[hit]
        old = self.best[kind, at]
        self.best[kind, at] = np.where(old < 0, first, np.minimum(old, first))


NEAR = "word string, n_near long, near_n long, near_word string"


def compare(rows: DataFrame) -> DataFrame:
    """Per word and tile side: the number of near words and the best of them."""
    order = ["key", "size", "lo", "hi", "rest", F.length("inside"), F.desc("n"), "inside"]
    dealt = rows.repartition("key").sortWithinPartitions(*order)

    def run(batches: Iterable[dict[str, list]]) -> Iterator[dict]:
        names = ("size", "lo", "hi", "rest", "inside", "n")
        held: dict[str, list] = {c: [] for c in names}

        def work(n: int) -> dict:
            size, lo, hi = (np.array(held[c][:n], np.int64) for c in ("size", "lo", "hi"))
            rest, inside, count = (held[c][:n] for c in ("rest", "inside", "n"))
            group = np.cumsum([True, *(a != b for a, b in zip(zip(size, lo, hi, rest), zip(size[1:], lo[1:], hi[1:], rest[1:])))])
            tiles = Tiles(group, size, lo, hi, inside).run()
            word = [r[:a] + x + r[a:] for r, a, x in zip(rest, lo.tolist(), inside)]
            out: dict[str, list] = {"word": [], "n_near": [], "near_n": [], "near_word": []}
            for kind in (0, 1):
                for i in np.flatnonzero(tiles.near[kind]).tolist():
                    j = int(tiles.best[kind, i])
                    for c, v in zip(out, (word[i], int(tiles.near[kind, i]), count[j], word[j])):
                        out[c].append(v)
            return out

        for cols in batches:
            for c in names:
                held[c].extend(cols[c])
            n = len(held["n"])
            if n >= ROWS:
                last = lambda i: tuple(held[c][i] for c in names[:4])
                at, end = n - 1, last(n - 1)
                while at and last(at - 1) == end:
                    at -= 1
                if at:
                    yield work(at)
                    held = {c: v[at:] for c, v in held.items()}
        if held["n"]:
            yield work(len(held["n"]))

    return stream_batches(dealt.select("size", "lo", "hi", "rest", "inside", "n"), run, NEAR)


def near_words(vocabulary: DataFrame, min_length: int = MIN_LENGTH, group: int = GROUP) -> DataFrame:
    """``vocabulary(word, n)``, distinct words -> word, n, n_near, near_n, near_word (the near word
    of largest n, the smallest of these in code-point order)."""
    found = None
    rows = halves(vocabulary, min_length)
    while True:
        rows = materialize(rows, "members")
        # a hash that two groups share makes both look larger: they are cut finer than need be
        large = materialize(rows.where("hi - lo > 1").groupBy("key").agg(F.count("*").alias("rows")).where(F.col("rows") > group).select("key"), "large")
        part = compare(rows.join(large, "key", "left_anti"))
        found = part if found is None else found.unionByName(part)
        if large.isEmpty():
            break
        rows = finer(rows.join(large, "key", "left_semi"))
    own = vocabulary.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("near_n"), F.lit(None).cast("string").alias("near_word"))
    both = own.unionByName(found.select("word", F.lit(None).cast("long").alias("n"), "n_near", "near_n", "near_word"))
    best = F.min(F.when(F.col("near_n").isNotNull(), F.struct((-F.col("near_n")).alias("less"), "near_word")))
    return both.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("best")).select(
        "word", "n", "n_near", (-F.col("best.less")).alias("near_n"), F.col("best.near_word").alias("near_word"))


def roots(links: DataFrame) -> DataFrame:
    """``links(word, form)`` without circles -> word, root: the last of its chain. Chains halve each round."""
    at = materialize(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = at.select(F.col("word").alias("via"), F.col("root").alias("further"))
        on = at.join(step, at.root == step.via, "left")
        at = materialize(on.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if at.where("moved").isEmpty():
            return at.select("word", "root")


def group_variants(vocabulary: DataFrame, min_length: int = MIN_LENGTH, times: int = TIMES, group: int = GROUP) -> DataFrame:
    """``vocabulary(word, n)`` -> word, form, root, n, n_near, form_n."""
    prepare(vocabulary.sparkSession)
    vocabulary = materialize(vocabulary, "words")
    is_form = F.col("near_n") >= times * F.col("n")
    rows = materialize(near_words(vocabulary, min_length, group).select(
        "word", F.when(is_form, F.col("near_word")).alias("form"), "n", "n_near", F.when(is_form, F.col("near_n")).alias("form_n")), "near")
    ends = roots(rows.where("form IS NOT NULL")).withColumnRenamed("word", "root_of")
    return rows.join(ends, rows.word == ends.root_of, "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13(spark: SparkSession, docs: DataFrame) -> DataFrame:
    prepare(spark)
    return group_variants(words(docs))
