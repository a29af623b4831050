"""Repeated passages: every byte under a string of LENGTH bytes that also starts anywhere else is removed.

Distributed prefix doubling on sampled positions. A window of LENGTH bytes is represented by its anchor, the place
within it whose GRAM bytes have the smallest hash (the first of equals): two equal windows have their anchors at the same
offset, so only places whose anchors agree can match. Ranks are names: equal strings of one round's length have equal
names, given by hashing and counted by Spark's sort and aggregation. The lengths grow, and places that are unique at a length go no further:

1. GRAM bytes at each anchor;
2. all windows of an anchor together, up to 2 LENGTH - GRAM bytes: if that context occurs elsewhere, all of them repeat;
3. the single windows of the anchors that are left, by the pair of names of their two halves: contexts with equal GRAM bytes
   meet in one task, and of those GRAM bytes that stand in very many contexts every window moves on its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.filters import Filter
from cairn.llm.shared import doc_texts, slices, table, written

LENGTH = 200
GRAM = 32
#: GRAM bytes that stand in more different contexts than this don't meet in one task: so many take it some 100 MB.
MEET = 16_384
_SLICE = 1 << 19
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_BYTES = [np.random.default_rng(seed).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1) for seed in (11, 12)]


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2^64, and of its inverse, size of them or more; the longest table so far is kept."""
    if base not in _POWERS or len(_POWERS[base][0]) <= size:
        inverse = pow(base, -1, 1 << 64)
        _POWERS[base] = tuple(np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, b, np.uint64))]) for b in (base, inverse))
    return _POWERS[base]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(29))


class Hashes:
    """Hashes of any substrings of a buffer, in two independent kinds."""

    def __init__(self, raw: np.ndarray):
        size = 1 << max(16, (len(raw) + 1).bit_length())
        self.sums, self.inverse = [], []
        for base, values in zip(_BASES, _BYTES, strict=True):
            up, down = _powers(base, size)
            self.sums.append(np.concatenate([[np.uint64(0)], np.cumsum(values[raw] * up[: len(raw)])]))
            self.inverse.append(down)

    def __call__(self, start: np.ndarray, end: np.ndarray, kind: int) -> np.ndarray:
        return _mixed((self.sums[kind][end] - self.sums[kind][start]) * self.inverse[kind][start])


def anchors(raw: np.ndarray, ends: np.ndarray, hashes: Hashes, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first and last start of its windows, over a buffer of documents that end at `ends`; no window crosses them."""
    n = len(raw)
    if n < length:
        return (np.zeros(0, np.int64),) * 3
    places = np.arange(n - gram + 1)
    bits = np.uint64(n.bit_length())
    key = (hashes(places, places + gram, 0) >> bits << bits) | places.astype(np.uint64)
    width, low, step = length - gram + 1, key, 1
    while 2 * step <= width:
        low = np.minimum(low[: len(low) - step], low[step:])
        step *= 2
    rest = width - step
    low = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
    anchor = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    start = np.arange(len(anchor))
    own_end = np.repeat(ends, np.diff(ends, prepend=0))[: len(anchor)]
    valid = start + length <= own_end
    start, anchor = start[valid], anchor[valid]
    if not len(start):
        return (np.zeros(0, np.int64),) * 3
    cut = np.flatnonzero((np.diff(anchor) != 0) | (np.diff(start) != 1)) + 1
    first = np.concatenate([[0], cut])
    return anchor[first], start[first], start[np.concatenate([cut, [len(start)]]) - 1]


def _window_names(hashes: Hashes, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of windows, 64 bits and 31 more, from the names of their halves."""
    half = length // 2
    left, right = (hashes(start + i, start + i + half, int(i > 0)) for i in (0, length - half))
    name = left * np.uint64(0x165667B19E3779F9) + right
    return name, ((left ^ (right * np.uint64(0xA0761D6478BD642F))) >> np.uint64(33)).astype(np.int32)


def text_id(raw: bytes) -> int:
    """A signed 64-bit name of a text; equal texts are one text, which occurs as often as its rows."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(raw))))


def _over(docs: DataFrame, make: Callable[[list[bytes], np.ndarray, np.ndarray], list], schema: str, most: int = _SLICE) -> DataFrame:
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, most):
            texts = [t.encode() for t in batch.column(1).to_pylist()]
            raw = np.frombuffer(b"".join(texts), np.uint8)
            ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
            columns = make(texts, raw, ends)
            if len(columns[0]):
                yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in columns], names)

    return doc_texts(docs).mapInArrow(run, schema)


def _text_rows(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """tid and text, once, of the texts whose tid is among ids; a filter of fixed size keeps most others from moving."""
    wanted = Filter.of(ids.select("tid"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            tids = np.array([text_id(t.encode()) for t in batch.column(1).to_pylist()], np.int64)
            keep = pa.array(wanted.holds(tids.view(np.uint64)))
            yield pa.RecordBatch.from_arrays([pa.array(tids).filter(keep), batch.column(1).filter(keep)], ["tid", "text"])

    return doc_texts(docs).mapInArrow(run, "tid long, text string").join(ids.select("tid").distinct(), "tid", "left_semi").dropDuplicates(["tid"])


def texts_of(docs: DataFrame) -> DataFrame:
    """doc_id, tid, n_bytes, sha256 of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            raw = [t.encode() for t in batch.column(1).to_pylist()]
            columns = [pa.array(map(text_id, raw), pa.int64()), pa.array(map(len, raw), pa.int64()), pa.array([hashlib.sha256(r).hexdigest() for r in raw])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "tid", "n_bytes", "sha256"])

    return doc_texts(docs).mapInArrow(run, "doc_id long, tid long, n_bytes long, sha256 string")


def repeated_windows(docs: DataFrame, copied: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """tid, first, last: runs of starts of windows that occur more than once, of the texts that aren't in copied (tid).

    Two rows are one place if they have the same tid and position; a smallest and a largest place tell whether there are
    two, so that however frequent a name is, one row a task and name is moved for it.
    """

    def sampled(texts: list[bytes], raw: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        hashes = Hashes(raw)
        at, first, last = anchors(raw, ends, hashes, length, gram)
        owner = np.searchsorted(ends, at, side="right")
        base = (ends - np.fromiter(map(len, texts), np.int64, len(texts)))[owner]
        tids = np.fromiter(map(text_id, texts), np.int64, len(texts))[owner]
        context = hashes(first, last + length, 1) + _mixed((at - first).astype(np.uint64) * np.uint64(1 << 32) + (last - first).astype(np.uint64))
        return [hashes(at, at + gram, 0), context, tids, first - base, (last - first).astype(np.int16)]

    rows = _over(docs, sampled, "gram long, context long, tid long, first long, more short")
    place = F.xxhash64("tid", "first")
    repeated = rows.groupBy("gram").agg(F.min(place).alias("low"), F.max(place).alias("high")).where("low <> high").select("gram")
    rows = written(rows.join(repeated, "gram").distinct(), "anchors")
    names = rows.groupBy("gram", "context").agg(F.min(place).alias("low"), F.max(place).alias("high"))
    by_gram = names.groupBy("gram").agg(F.max(F.col("low") == F.col("high")).alias("open"), F.count(F.lit(1)).alias("contexts"))
    names = names.join(by_gram.where("open and contexts > 1").select("gram", F.lit(True).alias("open"), (F.col("contexts") > MEET).alias("many")), "gram", "left")
    rows = written(rows.join(names, ["gram", "context"]).withColumn("place", place), "contexts")
    whole = rows.where("low <> high").select("tid", "first", (F.col("first") + F.col("more")).alias("last"))
    # What is left: the places of contexts that occur once, and one place of each other context that could match them.
    single = rows.where("open and place = low").select("tid", "many", F.struct("gram", "first", "more", (F.col("low") == F.col("high")).alias("single")).alias("run"))
    single = written(single.groupBy("many", "tid").agg(F.collect_set("run").alias("runs")), "open-anchors")
    few, many = (single.where(F.col("many") == m).select("tid", "runs") for m in (False, True))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, _SLICE):
            out = []
            for tid, text, runs in zip(*(batch.column(c).to_pylist() for c in ("tid", "text", "runs")), strict=True):
                raw = text.encode()
                out += [(r["gram"], tid, r["first"], r["single"], raw[r["first"] : r["first"] + r["more"] + length]) for r in runs]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()), strict=True)], ["gram", "tid", "first", "asked", "bytes"])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def settled(rows: pa.Table) -> pa.RecordBatch:
            gram, tid, first = (rows.column(c).to_numpy() for c in ("gram", "tid", "first"))
            raw = rows.column("bytes").to_pylist()
            sizes = np.fromiter(map(len, raw), np.int64, len(raw))
            begin = np.cumsum(sizes) - sizes
            windows = sizes - length + 1
            within = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
            name = _window_names(Hashes(np.frombuffer(b"".join(raw), np.uint8)), np.repeat(begin, windows) + within, length)[0]
            name += np.repeat(gram.view(np.uint64), windows) * np.uint64(0x8EBC6AF09C88C6E3)
            order = np.argsort(name)
            same = name[order][1:] == name[order][:-1]
            twice = np.zeros(len(name), bool)
            twice[order] = np.append(same, False) | np.append(False, same)
            twice &= np.repeat(rows.column("asked").to_numpy(zero_copy_only=False), windows)
            owner, at = np.repeat(np.arange(len(raw)), windows)[twice], within[twice]
            cut = np.flatnonzero((np.diff(owner) != 0) | (np.diff(at) != 1)) + 1
            a, b = (np.concatenate([[0], cut]), np.concatenate([cut, [len(at)]]) - 1) if len(at) else (np.zeros(0, np.int64),) * 2
            return pa.RecordBatch.from_arrays([pa.array(tid[owner[a]]), pa.array(first[owner[a]] + at[a]), pa.array(first[owner[a]] + at[b])], ["tid", "first", "last"])

        for batch in batches:
            if not batch.num_rows:
                continue
            gram = batch.column(0).to_numpy()
            cut = int(np.searchsorted(gram, gram[-1]))
            if cut or held and held[-1].column(0)[-1].as_py() != gram[0]:
                held.append(batch.slice(0, cut))
                rows = pa.Table.from_batches(held)
                if rows.num_rows:
                    yield settled(rows)
                held = []
            held.append(batch.slice(cut))
        if held:
            yield settled(pa.Table.from_batches(held))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, _SLICE):
            for tid, text, runs in zip(*(batch.column(c).to_pylist() for c in ("tid", "text", "runs")), strict=True):
                hashes = Hashes(np.frombuffer(text.encode(), np.uint8))
                start = np.concatenate([np.arange(r["first"], r["first"] + r["more"] + 1) for r in runs])
                asked = np.repeat([r["single"] for r in runs], [r["more"] + 1 for r in runs])
                name, check = _window_names(hashes, start, length)
                yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(check), pa.array(np.full(len(start), tid)), pa.array(start), pa.array(asked)], ["name", "rest", "tid", "first", "asked"])

    apart = _text_rows(docs, few).join(few, "tid").mapInArrow(contexts, "gram long, tid long, first long, asked boolean, bytes binary")
    found = apart.repartition("gram").sortWithinPartitions("gram").mapInArrow(met, "tid long, first long, last long")
    single_windows = _text_rows(docs, many).join(many, "tid").mapInArrow(windows, "name long, rest int, tid long, first long, asked boolean")
    twice = single_windows.groupBy("name", "rest").agg(F.min(place).alias("low"), F.max(place).alias("high")).where("low <> high").select("name", "rest")
    found = found.unionByName(single_windows.where("asked").join(twice, ["name", "rest"]).select("tid", "first", F.col("first").alias("last")))
    return whole.distinct().unionByName(found).join(copied, "tid", "left_anti")


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 of every document.

    Texts are taken as UTF-8 bytes (null: empty); matches don't cross documents; overlaps count; all is judged on
    the input. A text that occurs in more than one row goes whole, if it has `length` bytes. Shorter texts stay. Rows
    are told apart by their texts, so repeated rows and repeated or missing doc_ids are rows like others; an empty table
    gives no rows.
    """
    members = written(texts_of(docs), "texts")
    copied = members.groupBy("tid").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1").select("tid")
    runs = repeated_windows(docs, copied, length, gram).groupBy("tid").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    runs = written(runs, "runs")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for tid, text, found in zip(*(batch.column(c).to_pylist() for c in ("tid", "text", "runs")), strict=True):
                raw = np.frombuffer(text.encode(), np.uint8)
                depth = np.zeros(len(raw) + 1, np.int64)
                np.add.at(depth, [r["first"] for r in found], 1)
                np.add.at(depth, [r["last"] + length for r in found], -1)
                gone = np.cumsum(depth)[:-1] > 0
                spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                out.append((tid, int(gone.sum()), spans, hashlib.sha256(raw[~gone].tobytes()).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["tid", "n_removed", "n_spans", "kept_sha256"])

    changed = written(_text_rows(docs, runs).join(runs, "tid").mapInArrow(cut, "tid long, n_removed long, n_spans long, kept_sha256 string"), "cut")
    all_gone = copied.select("tid", F.lit(True).alias("copied"))
    out = members.join(changed, "tid", "left").join(all_gone, "tid", "left")
    gone = F.coalesce("copied", F.lit(False)) & (F.col("n_bytes") >= length)
    return out.select(
        "doc_id", "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, hashlib.sha256(b"").hexdigest()).otherwise(F.coalesce("kept_sha256", "sha256")).alias("kept_sha256"),
    )


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query over every document."""
    return without_repeats(table(spark, sf_dir, "documents"))
