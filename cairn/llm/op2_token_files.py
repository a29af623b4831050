"""Token ids in binary files whose document boundaries are Elias-Fano encoded.

A file holds blocks, each followed by a line feed. A block: a fixed header (see _HEADER), the Elias-Fano codes of the
document ids and of the document ends, then the ids of all its documents as little-endian unsigned integers, of 16
bits if all fit and else of 32.
Files and blocks are in ascending doc_id order by their shard and block numbers.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.llm.library_tokenizer import LibraryTokenizer
from cairn.llm.pretoken import ChunkEncoder
from cairn.llm.shared import TOKENIZER_FILE, doc_texts, new_path, slices, table, written

END_ID = 2
MAGIC = b"CAIRNEF1"
# magic, bytes of an id, shard, block, documents, of them without a doc_id, ids, smallest doc_id, bytes of the two codes
_HEADER = struct.Struct("<8sIIIQQQqQQ")
BLOCK_IDS = 4 << 20
PART_BYTES = 16 << 20
_SLICE = 6 << 20
_EVERY = 256


class EliasFano:
    """A non-decreasing sequence of n whole numbers from 0 to u in about n (2 + log2(u / n)) bits.

    The low bits of each number lie packed; the high bits are unary: number i sets bit (high + i). Every 256th set
    bit's place is kept in 32 bits (a block holds some 3 n bits at most, far fewer than 2^32), so select(i) scans a bounded stretch and needs no table of offsets.
    """

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, (top // n).bit_length() - 1) if n else 0
        low = np.packbits(((values[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little").tobytes() if bits else b""
        places = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        marks = np.zeros((top >> bits) + n + 1, np.uint8)
        marks[places] = 1
        return cls(n, bits, low, np.packbits(marks, bitorder="little").tobytes(), places[::_EVERY].astype("<u4"))

    def to_bytes(self) -> bytes:
        return struct.pack("<QBQQQ", self.n, self.low_bits, len(self.low), len(self.high), len(self.samples)) + self.low + self.high + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> EliasFano:
        n, bits, a, b, c = struct.unpack_from("<QBQQQ", raw)
        at = struct.calcsize("<QBQQQ")
        return cls(n, bits, raw[at : at + a], raw[at + a : at + a + b], np.frombuffer(raw, "<u4", c, at + a + b))

    def _low(self, i: int) -> int:
        at = i * self.low_bits
        word = int.from_bytes(self.low[at // 8 : (at + self.low_bits + 7) // 8], "little")
        return word >> at % 8 & (1 << self.low_bits) - 1

    def select(self, i: int) -> int:
        """Number i."""
        place = int(self.samples[i // _EVERY])
        left = i % _EVERY
        at = place // 8
        byte = self.high[at] >> place % 8 << place % 8
        while (ones := byte.bit_count()) <= left:
            left -= ones
            at += 1
            byte = self.high[at]
        for _ in range(left):
            byte &= byte - 1
        place = 8 * at + (byte & -byte).bit_length() - 1
        return place - i << self.low_bits | self._low(i)

    def all(self) -> np.ndarray:
        places = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))
        high = (places - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)
        if not self.low_bits:
            return high.astype(np.int64)
        bits = np.unpackbits(np.frombuffer(self.low, np.uint8), bitorder="little")[: self.n * self.low_bits].reshape(self.n, -1)
        return (high + bits.astype(np.uint64) @ (np.uint64(1) << np.arange(self.low_bits, dtype=np.uint64))).astype(np.int64)


def pack_block(shard: int, block: int, doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    """doc_ids ascending, None first."""
    nulls = sum(d is None for d in doc_ids)
    known = np.array(doc_ids[nulls:], np.int64)
    smallest = int(known[0]) if len(known) else 0
    names = EliasFano.of(known.astype(np.uint64) - np.uint64(smallest % (1 << 64))).to_bytes()
    ends = EliasFano.of(np.cumsum([len(x) for x in ids])).to_bytes()
    body = np.concatenate(ids)
    width = 2 if body.max(initial=0) < 1 << 16 else 4
    return _HEADER.pack(MAGIC, width, shard, block, len(doc_ids), nulls, len(body), smallest, len(names), len(ends)) + names + ends + body.astype(f"<u{width}").tobytes()


def unpack_blocks(raw: bytes) -> Iterator[tuple[int, int, list[int | None], EliasFano, np.ndarray]]:
    """shard, block, doc_ids, document ends, ids of each block of a file."""
    at, view = 0, memoryview(raw)
    while at < len(raw):
        magic, width, shard, block, _, nulls, n_ids, smallest, a, b = _HEADER.unpack_from(raw, at)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at += _HEADER.size
        names = EliasFano.from_bytes(bytes(view[at : at + a])).all() + smallest
        ends = EliasFano.from_bytes(bytes(view[at + a : at + a + b]))
        at += a + b
        yield shard, block, [None] * nulls + names.tolist(), ends, np.frombuffer(view[at : at + width * n_ids], f"<u{width}")
        at += width * n_ids + 1


@lru_cache(maxsize=2)
def _encoder(path: str) -> ChunkEncoder:
    library = LibraryTokenizer(path)
    return ChunkEncoder(library, library.specials)


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, part_bytes: int = PART_BYTES) -> None:
    """Writes the ids of all documents (null text: empty), each followed by end_id, in ascending doc_id order.

    The documents are dealt by ranges of doc_id, about part_bytes of text to a file; rows without a doc_id come first,
    rows with the same one stand next to each other. An empty table gives no block. Spark's text writer stores the blocks, as a string of
    raw bytes a line, in any file system that it can reach; a task that is lost is run again and its file committed once.
    """
    texts = doc_texts(docs)
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // part_bytes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard, block = _encoder(tokenizer), TaskContext.get().partitionId(), 0
        names: list[int | None] = []
        held: list[np.ndarray] = []
        end, total = np.array([end_id], np.uint32), 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([pack_block(shard, block, names, held)], pa.binary())], ["block"])

        for batch in slices(batches, 1, _SLICE):
            for name, ids in zip(batch.column(0).to_pylist(), encoder(batch.column(1)), strict=True):
                names.append(name)
                held.append(np.append(ids, end))
                total += len(held[-1])
                if total >= BLOCK_IDS:
                    yield flush()
                    names, held, total, block = [], [], 0, block + 1
        if names:
            yield flush()

    ranged = texts.repartitionByRange(int(parts), "doc_id").sortWithinPartitions("doc_id")
    ranged.mapInArrow(run, "block binary").select(F.col("block").cast("string").alias("value")).write.option("compression", "none").option("lineSep", "\n").text(path)


def read_token_files(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, ids of every document.

    Boundaries come from the Elias-Fano codes. A document's place within its block is known where the block is read;
    the sum of the blocks before is taken over one row a block.
    """
    schema = "shard int, block int, doc_id long, place long, start_in_block long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                for shard, block, names, ends, ids in unpack_blocks(raw.as_py()):
                    end = np.fromiter(map(ends.select, range(len(names))), np.int64, len(names))
                    start = np.concatenate([[0], end[:-1]])
                    wide = ids.astype("<u4")
                    crc = [zlib.crc32(wide[a:b]) for a, b in zip(start.tolist(), end.tolist(), strict=True)]
                    n = len(names)
                    columns = [pa.array([shard] * n, pa.int32()), pa.array([block] * n, pa.int32()), pa.array(names, pa.int64()), pa.array(np.arange(n)), pa.array(start), pa.array(end - start), pa.array(crc, pa.int64())]
                    if with_ids:
                        columns.append(pa.ListArray.from_arrays(np.concatenate([start, end[-1:]]).astype(np.int32), pa.array(ids.astype(np.int64))))
                    yield pa.RecordBatch.from_arrays(columns, [c.split(" ")[0] for c in schema.split(", ")])

    files = spark.read.format("binaryFile").load(path).select("content")
    rows = written(files.mapInArrow(run, schema), "token-rows")
    blocks = rows.groupBy("shard", "block").agg(F.sum("n_tokens").alias("in_block"))
    before = blocks.select("shard", "block", (F.sum("in_block").over(Window.orderBy("shard", "block")) - F.col("in_block")).alias("before"))
    return rows.join(before, ["shard", "block"]).select("doc_id", (F.col("before") + F.col("start_in_block")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: writes the ids of every document and reads the files back."""
    path = new_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path(TOKENIZER_FILE))
    return read_token_files(spark, path, with_ids=False)
