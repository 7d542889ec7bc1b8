r"""Token-ID output: fixed-width bit packing with block offsets.

A file holds ids in the fewest bits that the vocabulary needs (49,408 ids: 16),
little-endian and without gaps inside a block of 65,536 ids. Its footer has the
byte offset of every block, and for every document its id and the place of its
first token, so that numpy unpacks whole blocks at once and any document or
range of ids is read by the bytes of its blocks alone:

    magic "TOKBITS1" | bits u32 | ids a block u32 | blocks
    | offsets u64 x (blocks + 1) | places u64 x (documents + 1) | ids i64 x documents | null flags u8 x documents
    | blocks u64 | documents u64 | place of the footer u64 | magic

Documents are dealt by range of doc_id and sorted inside a task, which encodes
and writes as it reads: a file ends at MOST_IDS tokens or MOST_DOCUMENTS
documents, so neither a task nor a file depends on how many rows have one id.
A task names its files anew at each attempt and returns a row for each; only
files of rows that Spark has committed to the manifest table count, so lost
executors and repeated tasks change nothing. The manifest, a row for each file,
is small enough for one running sum that gives each file the ids before it.

Null text counts as empty: the end id alone. Null ids come first; rows of one id
are ordered by a hash of their text, repeated rows follow one another. A text of
any length is encoded whole and written by blocks. Extra columns, whatever their
names, are not read. An empty table gives no files and an empty result.
"""

from __future__ import annotations

import uuid
import zlib
from array import array
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import filesystem, new_folder
from .packing import portions, words_of

MAGIC = b"TOKBITS1"
BLOCK = 1 << 16
MOST_IDS, MOST_DOCUMENTS = 1 << 27, 1 << 20
END = 2
MANIFEST = "part int, number int, path string, n_ids long, n_documents long"


def width(vocabulary: int) -> int:
    """The least number of bits that holds every id below vocabulary."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids in bits bits each, the lowest bit first, padded to whole bytes."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if bits % 8 == 0:
        return raw[:, : bits // 8].tobytes()
    return np.packbits(np.unpackbits(raw, axis=1, count=bits, bitorder="little").ravel(), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, n: int, first: int = 0) -> np.ndarray:
    """n ids from number first on, all at once: each is what five bytes from its own first one hold, shifted and cut."""
    raw = np.frombuffer(data, np.uint8)
    if bits % 8 == 0:
        out = np.zeros((n, 4), np.uint8)
        out[:, : bits // 8] = raw.reshape(-1, bits // 8)[first : first + n]
        return out.view("<u4").ravel()
    raw = np.concatenate([raw, np.zeros(5, np.uint8)])
    at = np.arange(first, first + n, dtype=np.int64) * bits
    byte, value = at >> 3, np.zeros(n, np.uint64)
    for k in range(5):
        value |= raw[byte + k].astype(np.uint64) << np.uint64(8 * k)
    return (value >> (at & 7).astype(np.uint64) & np.uint64((1 << bits) - 1)).astype(np.uint32)


class Writer:
    """One file, written block by block."""

    def __init__(self, uri: str, bits: int, block: int = BLOCK):
        fs, path = filesystem(uri)
        self.bits, self.block = bits, block
        self.out = fs.open_output_stream(path)
        self.out.write(MAGIC + np.array([bits, block], "<u4").tobytes())
        self.at, self.offsets, self.waiting = len(MAGIC) + 8, array("Q"), bytearray()
        self.n_ids, self.places, self.ids, self.nulls = 0, array("Q", [0]), array("q"), bytearray()

    def put(self, doc_id: int | None, data: bytes) -> None:
        """A document and its ids as little-endian unsigned 32-bit integers."""
        self.waiting += data
        self.n_ids += len(data) // 4
        self.places.append(self.n_ids)
        self.ids.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        whole = len(self.waiting) // (4 * self.block) * 4 * self.block
        for k in range(0, whole, 4 * self.block):
            self._block(bytes(self.waiting[k : k + 4 * self.block]))
        if whole:
            del self.waiting[:whole]

    def _block(self, data: bytes) -> None:
        packed = pack(np.frombuffer(data, "<u4"), self.bits)
        self.out.write(packed)
        self.offsets.append(self.at)
        self.at += len(packed)

    def close(self) -> None:
        if self.waiting:
            self._block(bytes(self.waiting))
        blocks, footer = len(self.offsets), self.at
        self.offsets.append(self.at)
        for part, kind in ((self.offsets, "<u8"), (self.places, "<u8"), (self.ids, "<i8")):
            self.out.write(np.frombuffer(part, np.dtype(kind).newbyteorder("=")).astype(kind).tobytes())
        self.out.write(bytes(self.nulls) + np.array([blocks, len(self.ids), footer], "<u8").tobytes() + MAGIC)
        self.out.close()


class Reader:
    """Random access to one file: its footer is read at once, blocks as they are asked for."""

    def __init__(self, uri: str):
        fs, path = filesystem(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        tail = self._read(size - 32, 32)
        head = self._read(0, 16)
        if tail[24:] != MAGIC or head[:8] != MAGIC:
            raise ValueError(f"{uri} is not a whole file of token ids")
        self.bits, self.block = np.frombuffer(head[8:], "<u4").tolist()
        blocks, documents, footer = np.frombuffer(tail[:24], "<u8").tolist()
        data = self._read(footer, size - 32 - footer)
        cut = np.cumsum([0, 8 * (blocks + 1), 8 * (documents + 1), 8 * documents, documents]).tolist()
        self.offsets, self.places, self.ids, self.nulls = (np.frombuffer(data[a:b], kind) for (a, b), kind in zip(pairwise(cut), ("<u8", "<u8", "<i8", "u1"), strict=True))

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def __len__(self) -> int:
        return len(self.ids)

    def range(self, start: int, end: int) -> np.ndarray:
        """Ids start to end of the file, from the blocks that hold them."""
        if end <= start:
            return np.zeros(0, np.uint32)
        a, b = start // self.block, -(-end // self.block)
        at, to = int(self.offsets[a]), int(self.offsets[b])
        data = self._read(at, to - at)
        if self.block * self.bits % 8 == 0:
            return unpack(data, self.bits, end - start, start - a * self.block)
        parts = [unpack(data[int(self.offsets[k]) - at : int(self.offsets[k + 1]) - at], self.bits, min(self.block, int(self.places[-1]) - k * self.block)) for k in range(a, b)]
        return np.concatenate(parts)[start - a * self.block : end - a * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.range(int(self.places[k]), int(self.places[k + 1]))

    def checks(self) -> list[int]:
        """crc32 of every document's ids as little-endian unsigned 32-bit integers; reads block after block."""
        ends, out, k, crc = self.places.tolist(), [], 0, 0
        for a in range(0, ends[-1], self.block):
            b = min(a + self.block, ends[-1])
            data = memoryview(self.range(a, b).astype("<u4").tobytes())
            at = a
            while at < b:
                while ends[k + 1] <= at:  # documents without ids
                    out.append(crc)
                    k, crc = k + 1, 0
                to = min(ends[k + 1], b)
                crc, at = zlib.crc32(data[4 * (at - a) : 4 * (to - a)], crc), to
                if to == ends[k + 1]:
                    out.append(crc)
                    k, crc = k + 1, 0
        return out + [0] * (len(self) - len(out))

    def close(self) -> None:
        self.file.close()


def write(df: DataFrame, tokenizer: str, folder: str, text: str = "text", end: int = END, block: int = BLOCK) -> DataFrame:
    """Writes the ids of df's documents in ascending order of doc_id; gives the manifest, a row for each file."""
    bits = width(max(words_of(tokenizer).tokenizer.get_vocab_size(), end + 1))
    last = np.array([end], "<u4").tobytes()
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).withColumns({"_hash": F.xxhash64("text"), "_row": F.monotonically_increasing_id()})
    order = [F.asc_nulls_first("doc_id"), F.asc_nulls_first("_hash"), F.asc("_row")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, done, out = words_of(tokenizer), TaskContext.get().partitionId(), [], None

        def finish() -> None:
            out.close()
            done.append((part, len(done), path, out.n_ids, len(out.ids)))

        for b in batches:
            for some in portions(b, 1):
                for doc, ids in zip(some.column(0).to_pylist(), words.encode([t.as_py() or "" for t in some.column(1)]), strict=True):
                    if out is None:
                        path = f"{folder}/part-{part:05d}-{len(done):05d}-{uuid.uuid4().hex}.ids"
                        out = Writer(path, bits, block)
                    out.put(doc, ids + last)
                    if out.n_ids >= MOST_IDS or len(out.ids) >= MOST_DOCUMENTS:
                        finish()
                        out = None
        if out is not None:
            finish()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["part", "number", "path", "n_ids", "n_documents"])

    fs, place = filesystem(folder)
    fs.create_dir(place)
    rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")
    return manifest(df.sparkSession, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files of a manifest; start counts the ids of all files before."""
    before = F.sum("n_ids").over(W.orderBy("part", "number").rowsBetween(W.unboundedPreceding, -1))
    placed = files.select("path", F.coalesce(before, F.lit(0)).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                one = Reader(path)
                places, crc = one.places.astype(np.int64), one.checks()
                one.close()
                for at in range(0, len(one), 10_000):
                    to = min(at + 10_000, len(one))
                    ids = pa.array(one.ids[at:to], mask=one.nulls[at:to].astype(bool))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(places[at:to] + first), pa.array(np.diff(places[at : to + 1])), pa.array(crc[at:to], pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.repartition(max(files.count(), 1)).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def report(df: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """Writes df's ids into a new folder and gives what the files hold, read again."""
    return read(write(df, tokenizer, new_folder(df.sparkSession, "token_files"), text))
