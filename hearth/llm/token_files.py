"""Token-id files: independent zstandard frames, a trailing seek table, checksums.

A shard file holds the ids of consecutive documents (ascending doc_id over the shards):

    frame*            each an independent zstandard frame with the ids of whole documents
    directory         skippable frame: doc count, then per document a known-id flag, the
                      id, its frame, first token in the frame, token count
    seek table        skippable frame of the public zstd seekable format: per frame its
                      compressed size, content size, and the low 32 bits of XXH64 of
                      the content; then frame count, flags, magic number

A reader reads the two trailing tables and decompresses only the frames of the
documents asked for; each frame's checksum is verified. Ids are little-endian uint16
where the vocabulary fits, else uint32 (the width stands in the directory).

Writing: the table is range-partitioned by (doc_id, text hash), sorted inside the
partitions, and each task encodes and writes one shard under a name of its own attempt,
so a repeated task never touches another's file; the manifest (a Parquet table) names the
files that count. Files go to the shared folder, by the Arrow file system of its scheme.

Cases: a null or empty text is the end id alone. Null ids come first, equal ids stay
side by side in the order of their texts' hashes (identical rows are alike). An empty
table has no shards and no rows. A damaged frame raises ``ValueError``.
"""

from __future__ import annotations

import re
import struct
import unicodedata
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearth.llm.common import open_folder, prepare, stream_batches
from hearth.session import materialize, scratch_path

END_ID = 2
FRAME_BYTES = 1 << 17
SHARD_BYTES = 256 << 20
MOST_SHARDS = 1 << 20
SEEK_MAGIC = 0x8F92EAB1
SKIP_SEEK = 0x184D2A5E
SKIP_DIRECTORY = 0x184D2A5D
MEMO_WORDS = 480_000
MEMO_LENGTH = 64

# --- encoding ----------------------------------------------------------------


def _byte_symbols() -> list[str]:
    """The printable symbol of each byte in byte-level vocabularies: printable Latin-1
    characters stand for themselves, the others take the next code points from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(other)) for b in range(256)]


BYTE_SYMBOLS = _byte_symbols()


class Memo(dict):
    """Ids of strings, made where they are not known, ``most`` at most. The entries are two halves: a
    full younger one takes the place of the older one, and what is used again moves to the younger
    one, so frequent strings stay. Strings over ``MEMO_LENGTH`` are not kept."""

    def __init__(self, make: Callable[[str], bytes], most: int):
        super().__init__()
        self.make, self.half, self.older = make, max(1, most // 2), {}

    def __missing__(self, key: str) -> bytes:
        got = self.older.get(key)
        if got is None:
            got = self.make(key)
            if len(key) > MEMO_LENGTH:
                return got
        if len(self) >= self.half:
            self.older = dict(self)
            self.clear()
        self[key] = got
        return got


class Encoder:
    """Exact ids of the tokenizers library, with a bounded memo of blank-parted chunks.

    Only for tokenizers that drop white space (NFC, lower case, split into pieces that no
    blank enters): there a text's ids are those of its chunks in turn. Chunks of ASCII and
    Latin letters are split by the file's own pattern and go to the library's model piece
    by piece, as byte symbols; other chunks go through the whole library; texts in which
    chunking could differ (special token strings, not in NFC, control blanks, capital
    sigma) are encoded whole. A piece's ids are those of the chunk that it would be alone.
    """

    #: U+00C0 to U+024F are letters but for the two signs.
    _PLAIN = re.compile("[\x00-\x7f\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]*")
    _PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+|[0-9]|[^\\sa-z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+")
    _ODD = re.compile("[\x1c-\x1fΣİ]|<\\|")

    def __init__(self, path: str, memo_words: int = MEMO_WORDS):
        import json
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.tokenize = self.library.model.tokenize
        with open(path) as f:
            made = json.load(f)
        self.width = 2 if max(made["model"]["vocab"].values()) < 1 << 16 else 4
        kinds = [n["type"] for n in (made.get("normalizer") or {}).get("normalizers", [])]
        self.chunked = kinds == ["NFC", "Replace", "Lowercase"] and "'s|'t|'re" in json.dumps(made.get("pre_tokenizer"))
        self.chunks = Memo(self._chunk, memo_words)

    def _pack(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{'H' if self.width == 2 else 'I'}", *ids)

    def _whole(self, text: str) -> bytes:
        return self._pack(self.library.encode(text, add_special_tokens=False).ids)

    def _piece(self, symbols: str) -> bytes:
        return self._pack([t.id for t in self.tokenize(symbols)])

    def _chunk(self, chunk: str) -> bytes:
        plain = chunk.isascii()
        if plain and chunk.isalpha():
            return self._piece(chunk)
        if plain and chunk[:-1].isalpha():  # letters and one other sign are two pieces
            return self.chunks[chunk[:-1]] + self.chunks[chunk[-1]]
        if not plain and not self._PLAIN.fullmatch(chunk):
            return self._whole(chunk)
        pieces = self._PIECES.findall(chunk)
        if len(pieces) > 1:
            return b"".join([self.chunks[p] for p in pieces])
        return b"".join([self._piece("".join([BYTE_SYMBOLS[b] for b in p.encode()])) for p in pieces])

    def encode(self, text: str | None) -> bytes:
        """The ids of a text, packed; without the end id."""
        if not text:
            return b""
        if not self.chunked or self._ODD.search(text) or not (text.isascii() or unicodedata.is_normalized("NFC", text)):
            return self._whole(text)
        return b"".join(map(self.chunks.__getitem__, text.lower().split()))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


# --- one shard -----------------------------------------------------------------


class ShardWriter:
    """Writes one shard file; memory: one frame, 33 bytes a document and 12 a frame."""

    def __init__(self, out, width: int, frame_bytes: int = FRAME_BYTES):
        self.out, self.width, self.frame_bytes = out, width, frame_bytes
        self.zip = zstandard.ZstdCompressor(level=1, write_checksum=False, write_content_size=True)
        self.open: list[bytes] = []
        self.size = 0
        self.frames = array("I")  # compressed size, size, checksum of each
        self.known, self.docs = bytearray(), array("q")  # id, frame, first token, tokens of each
        self.tokens = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if self.size and self.size + len(ids) > self.frame_bytes:
            self._close_frame()
        n = len(ids) // self.width
        self.known.append(doc_id is not None)
        self.docs.extend((doc_id or 0, len(self.frames) // 3, self.size // self.width, n))
        self.open.append(ids)
        self.size += len(ids)
        self.tokens += n

    def _close_frame(self) -> None:
        content = b"".join(self.open)
        packed = self.zip.compress(content)
        self.out.write(packed)
        self.frames.extend((len(packed), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))
        self.open, self.size = [], 0

    def close(self) -> None:
        if self.open:
            self._close_frame()
        table = np.array(self.docs, "<i8").tobytes()
        body = struct.pack("<QB", len(self.known), self.width) + self.zip.compress(bytes(self.known) + table)
        self.out.write(struct.pack("<II", SKIP_DIRECTORY, len(body)) + body)
        seek = np.array(self.frames, "<u4").tobytes() + struct.pack("<IBI", len(self.frames) // 3, 0x80, SEEK_MAGIC)
        self.out.write(struct.pack("<II", SKIP_SEEK, len(seek)) + seek)


class ShardReader:
    """Random access to a shard; reads only the trailing tables and the frames asked for."""

    def __init__(self, file):
        self.file = file
        end = file.size()
        frames, flags, magic = struct.unpack("<IBI", self._at(end - 9, 9))
        if magic != SEEK_MAGIC or flags != 0x80:
            raise ValueError("no seek table")
        table = 12 * frames
        head = struct.unpack("<II", self._at(end - 17 - table, 8))
        if head != (SKIP_SEEK, table + 9):
            raise ValueError("damaged seek table")
        self.frames = [struct.unpack_from("<III", raw, 0) for raw in _cut(self._at(end - 9 - table, table), 12)]
        starts = np.concatenate(([0], np.cumsum([f[0] for f in self.frames], dtype=np.int64)))
        self.starts = starts.tolist()
        magic, size = struct.unpack("<II", self._at(self.starts[-1], 8))
        if magic != SKIP_DIRECTORY:
            raise ValueError("no directory")
        body = self._at(self.starts[-1] + 8, size)
        n, self.width = struct.unpack_from("<QB", body, 0)
        raw = zstandard.ZstdDecompressor().decompress(body[9:])
        self.known = np.frombuffer(raw[:n], np.uint8).astype(bool)
        self.docs = np.frombuffer(raw[n:], "<i8").reshape(-1, 4)
        self.last: tuple[int, bytes] = (-1, b"")

    def _at(self, start: int, size: int) -> bytes:
        self.file.seek(start)
        got = self.file.read(size)
        if len(got) != size:
            raise ValueError("file ends early")
        return got

    def frame(self, i: int) -> bytes:
        if self.last[0] != i:
            packed, size, check = self.frames[i]
            try:
                content = zstandard.ZstdDecompressor().decompress(self._at(self.starts[i], packed))
            except zstandard.ZstdError as e:
                raise ValueError(f"frame {i} is damaged") from e
            if len(content) != size or xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != check:
                raise ValueError(f"frame {i}: checksum differs")
            self.last = i, content
        return self.last[1]

    def ids(self, i: int) -> np.ndarray:
        """Ids of the i-th document of the shard, as little-endian uint32."""
        _, frame, first, n = self.docs[i].tolist()
        return np.frombuffer(self.frame(frame), f"<u{self.width}", n, first * self.width).astype("<u4")

    def doc_id(self, i: int) -> int | None:
        return int(self.docs[i, 0]) if self.known[i] else None

    def find(self, doc_id: int) -> list[int]:
        """Places of a document in the shard."""
        return np.flatnonzero((self.docs[:, 0] == doc_id) & self.known).tolist()


def _cut(raw: bytes, size: int) -> Iterator[bytes]:
    return (raw[i:i + size] for i in range(0, len(raw), size))


# --- a table ---------------------------------------------------------------------

MANIFEST = "shard int, path string, n_docs long, n_tokens long"


def shards_for(docs: DataFrame) -> int:
    """As many shards as the session shuffles into, and one for each ``SHARD_BYTES`` of the input by the
    planner's estimate (file sizes; nothing is read)."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # an estimate without files (local rows, unknown sources) can be any number
    return max(least, min(size // SHARD_BYTES, MOST_SHARDS))


def write(docs: DataFrame, tokenizer: str, folder: str | None = None, shards: int | None = None, end_id: int = END_ID,
          frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Encodes every text and writes the shards; returns the manifest, one row per shard."""
    spark = prepare(docs.sparkSession)
    folder = folder or scratch_path(spark, "tokens")
    shards = shards or shards_for(docs)
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).repartitionByRange(shards, "doc_id", "h").sortWithinPartitions("doc_id", "h")

    def run(batches: Iterable[dict[str, list]]) -> Iterator[dict]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        writer = None
        for cols in batches:
            if writer is None:
                enc = encoder(tokenizer)
                end = enc._pack([end_id])
                fs, base = open_folder(folder)
                fs.create_dir(base, recursive=True)
                name = f"shard-{shard:06d}-{uuid.uuid4().hex[:12]}.tok"
                out = fs.open_output_stream(f"{base}/{name}")
                writer = ShardWriter(out, enc.width, frame_bytes)
            for i, text in zip(cols["doc_id"], cols["text"]):
                writer.add(i, enc.encode(text) + end)
        if writer is not None:
            writer.close()
            out.close()
            yield {"shard": [shard], "path": [f"{folder}/{name}"], "n_docs": [len(writer.known)], "n_tokens": [writer.tokens]}

    return materialize(stream_batches(rows, run, MANIFEST), "manifest")


READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read(manifest: DataFrame) -> DataFrame:
    """Reads the files back, every document: its place among all ids, its length and CRC-32.
    The driver holds one row per shard (the number of shards is a parameter)."""
    spark = manifest.sparkSession
    shards = manifest.orderBy("shard").collect()
    start, placed = 0, []
    for r in shards:
        placed.append((r.path, start))
        start += r.n_tokens
    tasks = spark.createDataFrame(placed, "path string, start long").repartition(max(1, len(placed)), "path")

    def run(batches: Iterable[dict[str, list]]) -> Iterator[dict]:
        for cols in batches:
            for path, at in zip(cols["path"], cols["start"]):
                folder, _, name = path.rpartition("/")
                fs, base = open_folder(folder)
                with fs.open_input_file(f"{base}/{name}") as file:
                    shard = ShardReader(file)
                    n = shard.docs[:, 3]
                    begins = at + np.concatenate(([0], np.cumsum(n)[:-1])) if len(n) else n
                    for lo in range(0, len(n), 10_000):
                        hi = min(lo + 10_000, len(n))
                        yield {"doc_id": [shard.doc_id(i) for i in range(lo, hi)], "start": begins[lo:hi].tolist(),
                               "n_tokens": n[lo:hi].tolist(), "ids_crc32": [zlib.crc32(shard.ids(i).tobytes()) for i in range(lo, hi)]}

    return stream_batches(tasks, run, READ)


def op5(spark: SparkSession, docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    prepare(spark)
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return read(write(docs, tokenizer))
