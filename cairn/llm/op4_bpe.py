"""Byte-level BPE by a priority queue of merge ranks over a doubly linked list of symbols; decoding by the vocabulary."""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from cairn.llm.pretoken import ChunkEncoder
from cairn.llm.shared import TOKENIZER_FILE, doc_texts, slices, table

_PIECE_MEMO = 150_000
_CHUNK_MEMO = 500_000
_SLICE = 4 << 20


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, extra = [], 256
    for b in range(256):
        out.append(chr(b if b in plain else extra))
        extra += b not in plain
    return out


class BytePairs:
    """A byte-level BPE vocabulary read from a tokenizers JSON file, with its merges and added tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab: dict[str, int] = spec["model"]["vocab"]
        characters = byte_characters()
        byte_of = {c: b for b, c in enumerate(characters)}
        self.first = [vocab[c] for c in characters]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            self.merges[vocab[left] << 20 | vocab[right]] = (rank, vocab[left + right])
        self.bytes: list[bytes] = [b""] * (1 + max([*vocab.values(), *self.added.values()]))
        for token, i in vocab.items():
            self.bytes[i] = bytes(byte_of[c] for c in token)
        for token, i in self.added.items():
            self.bytes[i] = token.encode()
        self.decimal = [str(i) for i in range(len(self.bytes))]
        self.pieces = regex.compile(public_tokenizers.PATTERN)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")") if self.added else None
        self.memo: dict[str, list[int]] = {}

    def merged(self, raw: bytes) -> list[int]:
        """Ids of one piece. The queue holds rank and place of each adjacent pair; an entry is stale, and is skipped,
        when its left symbol has gone or the pair now at its place has another rank."""
        first, merges = self.first, self.merges
        ids: list[int] = [first[b] for b in raw]
        n = len(ids)
        if n < 2:
            return ids
        shift = n.bit_length()
        mask = (1 << shift) - 1
        rank_at = [-1] * n
        queue = []
        for i in range(n - 1):
            m = merges.get(ids[i] << 20 | ids[i + 1])
            if m:
                rank_at[i] = m[0]
                queue.append(m[0] << shift | i)
        if not queue:
            return ids
        heapq.heapify(queue)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while queue:
            entry = heapq.heappop(queue)
            i = entry & mask
            if rank_at[i] != entry >> shift:
                continue
            j = after[i]
            ids[i] = merges[ids[i] << 20 | ids[j]][1]
            ids[j] = rank_at[j] = -1
            k = after[i] = after[j]
            rank_at[i] = -1
            if k < n:
                before[k] = i
                m = merges.get(ids[i] << 20 | ids[k])
                if m:
                    rank_at[i] = m[0]
                    heapq.heappush(queue, m[0] << shift | i)
            h = before[i]
            if h >= 0:
                m = merges.get(ids[h] << 20 | ids[i])
                rank_at[h] = -1
                if m:
                    rank_at[h] = m[0]
                    heapq.heappush(queue, m[0] << shift | h)
        return [x for x in ids if x >= 0]

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        memo = self.memo
        for part in self.specials.split(text) if self.specials else [text]:
            if part in self.added:
                out.append(self.added[part])
                continue
            for piece in self.pieces.findall(part):
                ids = memo.get(piece)
                if ids is None:
                    ids = self.merged(piece.encode())
                    if len(memo) >= _PIECE_MEMO:
                        memo.clear()
                    if len(piece) <= 64:
                        memo[piece] = ids
                out += ids
        return out

    def encode_many(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all chunks, one after another, and the count of each."""
        each = [self.encode(c) for c in chunks]
        counts = np.fromiter(map(len, each), np.int64, len(each))
        return np.fromiter((i for ids in each for i in ids), np.uint32, int(counts.sum())), counts

    def decode(self, ids: list[int]) -> str:
        """The vocabulary's byte strings, one after another; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def _encoder(path: str) -> tuple[BytePairs, ChunkEncoder]:
    pairs = BytePairs(path)
    return pairs, ChunkEncoder(pairs.encode_many, tuple(pairs.added), _CHUNK_MEMO)


FIELDS = {
    "n_tokens": pa.int64(),
    "ids": pa.list_(pa.int32()),
    "decoded": pa.string(),
    "ids_sha256": pa.string(),
    "decoded_sha256": pa.string(),
}
_SPARK = {"n_tokens": "long", "ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}


def encode_decode(docs: DataFrame, path: str, fields: tuple[str, ...] = ("n_tokens", "ids", "decoded"), slice_bytes: int = _SLICE) -> DataFrame:
    """doc_id and the fields asked for: n_tokens, ids, decoded (the text got back from the ids), and the SHA-256 of
    ids (decimal, joined by commas) and of the decoded text.

    A map over the documents without a shuffle: repeated rows stay, an empty table gives none, null text counts as
    empty (no ids), a null doc_id stays null, and columns beyond doc_id and text are left out. A very long text is
    encoded whole; the queue keeps that at n log n. slice_bytes: about how much text a task encodes at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, encoder = _encoder(path)
        for batch in slices(batches, 1, slice_bytes):
            made: dict[str, list] = {f: [] for f in fields if f != "ids"}
            arrays = encoder(batch.column(1))
            for ids_array in arrays:
                ids = ids_array.tolist()
                if "n_tokens" in made:
                    made["n_tokens"].append(len(ids))
                if "ids_sha256" in made:
                    made["ids_sha256"].append(hashlib.sha256(",".join(map(pairs.decimal.__getitem__, ids)).encode()).hexdigest())
                if "decoded" in made or "decoded_sha256" in made:
                    text = pairs.decode(ids)
                    if "decoded" in made:
                        made["decoded"].append(text)
                    if "decoded_sha256" in made:
                        made["decoded_sha256"].append(hashlib.sha256(text.encode()).hexdigest())
            columns = {f: pa.array(v, FIELDS[f]) for f, v in made.items()}
            if "ids" in fields:
                ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
                flat = np.concatenate(arrays).view(np.int32)
                del arrays
                columns["ids"] = pa.ListArray.from_arrays(ends, pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(columns[f] for f in fields)], ["doc_id", *fields])

    return doc_texts(docs).mapInArrow(run, "doc_id long, " + ", ".join(f"{f} {_SPARK[f]}" for f in fields))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: counts and digests of ids and of decoded texts, of every document."""
    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER_FILE), ("n_tokens", "ids_sha256", "decoded_sha256"))
