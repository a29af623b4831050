"""N-gram Jaccard join: documents whose sets of word shingles overlap enough, and the components that their links make.

T-occurrence search in the manner of DivideSkip, with the inverted lists spread over the cluster. A set of n shingles can only be
linked with sets that share T = 75 % of n with it. Its T - k most frequent shingles, those with the longest lists, are skipped; the
short lists of the others are merged, and two sets that meet fewer than k times there cannot reach T. Those that do are settled
by probing the skipped, long ones: the smaller set's whole sorted array is looked up in the other's by binary search.

This is done twice. First with lists in the order of a hash and a large k, only counting, for each set, how many of its lists hold another set:
most sets never come to k and are linked with nothing. Then, for the sets left, with the true lengths of lists as the order.

Where very many sets hold one shingle, all pairs of the list would be too many. There a leader is taken from the list, and each set x of
the list is held against it. With h shingles in the leader, p of them missing in x and q of x missing in the leader, let e = 4p + 3q; x and the leader are linked
if e <= h. Two sets of which one isn't linked with the leader are linked with each other only if (e + e' - h) / 7 of the places at which they differ from
the leader are the same: T-occurrence again, over differences, which are few and mostly rare. Two sets that are both linked with the
leader are in one component. So a group of any size costs one comparison a member, and no link between components is missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.llm.filters import Filter
from cairn.llm.shared import discard, doc_texts, slices, table, text_or_empty, written

WORDS = 5
PERCENT = 75
#: Short lists that two linked sets share at least, in percent of a set: when sets are sorted out, and when pairs are formed.
SORTING, FORMING = 25, 6
#: A list is led, not paired, when it has more than so many pairs of different components for each of its sets.
LONG_LIST = 100
#: How often lists of differences that are long themselves are led again; what is long even then is paired block by block.
LEVELS = 4
#: Sets of a block: lists of more are dealt into blocks, and pairs of blocks meet in different tasks.
BLOCK = 1024
#: Hash functions by which sets first meet a likely partner; they only save work.
MEETINGS = 6
STAR = 64
_SLICE = 1 << 18
_FLUSH = 500_000
_PART_TOKENS = 2_000_000
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_BYTE = np.random.default_rng(8).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * _MULTIPLIERS[0]
    return x ^ (x >> np.uint64(29))


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2^64, and of its inverse."""
    base = int(_MULTIPLIERS[7])
    return tuple(np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, b, np.uint64))]) for b in (base | 1, pow(base | 1, -1, 1 << 64)))


def _raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of an array of texts, and where each text begins and the last ends."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For all texts at once: sorted distinct 64-bit hashes of the text's runs of five words (A-Z lower-cased; fewer
    words: all as one), one set after another, and the bounds of the sets."""
    raw, offsets = _raw(texts)
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    word = ~_SPACE[raw]
    starts, ends = word.copy(), word.copy()
    starts[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    filled = offsets[:-1] < offsets[1:]
    first, last = offsets[:-1][filled], offsets[1:][filled] - 1
    starts[first], ends[last] = word[first], word[last]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    up, down = _powers(1 << max(16, n.bit_length()))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[_LOWER[raw]] * up[:n])])
    h = _mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
    bounds = np.searchsorted(start, offsets)
    many = np.diff(bounds)
    total = np.zeros(max(0, len(h) - WORDS + 1), np.uint64)
    for i in range(WORDS):
        total += h[i : i + len(total)] * _MULTIPLIERS[i + 1]
    total = _mix(total)
    # A run counts where its document has enough words from it on; documents of fewer words have one of their own.
    ahead = np.repeat(bounds[1:], many)[: len(total)] - np.arange(len(total))
    keep = ahead >= WORDS
    sizes = np.maximum(many - WORDS + 1, (many > 0).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(sizes)])
    out = np.zeros(at[-1], np.uint64)
    long = many >= WORDS
    out[np.repeat(long, sizes)] = total[keep]
    for d in np.flatnonzero((many > 0) & ~long).tolist():
        own = h[bounds[d] : bounds[d + 1]]
        out[at[d]] = _mix((own * _MULTIPLIERS[: len(own)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(own)))[0]
    for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        out[x:y].sort()
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[at[:-1][sizes > 0]] = True
    return out[new], np.concatenate([[0], np.cumsum(new)])[at]


def shingles(text: str) -> np.ndarray:
    """The set of one text."""
    return shingle_sets(pa.array([text]))[0]


def _shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of a stand in b; both sorted."""
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return b[at] == a if len(b) else np.zeros(len(a), bool)


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two sorted sets overlap enough, by binary probes of the longer."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a) or 100 * len(a) < percent * len(b):
        return False
    both = int(_shared(a, b).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def parities(found: np.ndarray) -> bytes:
    """A set's parity sketch: as many bits as it has shingles, or up to twice as many, each flipped by those that fall on it."""
    bits = max(6, int(len(found) - 1).bit_length())
    at = (found * _MULTIPLIERS[4]) >> np.uint64(64 - bits)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=1 << bits) & 1).astype(np.uint8)).tobytes()


def may_link(a: bytes, b: bytes, together: int) -> bool:
    """False only for sets, of `together` shingles in sum, that differ in too many: each bit in which the sketches
    differ stands for a shingle at least that one of them lacks. The longer sketch is folded to the shorter."""
    x, y = (np.unpackbits(np.frombuffer(s, np.uint8)) for s in (a, b))
    while len(x) > len(y):
        x = x[::2] ^ x[1::2]
    while len(y) > len(x):
        y = y[::2] ^ y[1::2]
    return (100 + PERCENT) * int((x ^ y).sum()) <= (100 - PERCENT) * together


def _row_key() -> Column:
    """128-bit name of a row's doc_id and text together: a doc_id alone may stand for several texts, or be missing."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("none")), F.lit(":"), text_or_empty()).cast("binary")))


def _ceil_percent(percent: int, n):
    return -(-percent * n // 100)


def members_of(docs: DataFrame) -> DataFrame:
    """doc_id, key (128-bit name of doc_id and text), node (128-bit name of the set, null for an empty one), n_shingles of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, _SLICE):
            found, at = shingle_sets(batch.column(1))
            nodes = pa.array([xxhash.xxh3_128_digest(found[x:y].tobytes()) if y > x else None for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), nodes, pa.array(np.diff(at))], ["doc_id", "key", "node", "n_shingles"])

    return doc_texts(docs).withColumn("key", _row_key()).mapInArrow(run, "doc_id long, key binary, node binary, n_shingles long")


def _half(node: bytes) -> int:
    """The first 64 bits of a name, zero left out: that stands for "another set"."""
    return int.from_bytes(node[:8], "little", signed=True) or 1


def met_counts(docs: DataFrame, parts: int) -> DataFrame:
    """half (the first bytes of a set's name), times: how many of a set's first shingles, in the order of their hashes, stand among
    the first of another set too, or more.

    What a task has read is counted before it moves: a list that already has two sets there sends one entry, so that no list is long. Shingles
    move as 32 bits and their part, which can only make counts too large.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        seen: dict[bytes, int] = {}
        count = 0

        def flush() -> pa.RecordBatch:
            token, owner = (np.concatenate(c) for c in zip(*held, strict=True))
            names = np.fromiter(map(_half, seen), np.int64, len(seen))
            order = np.argsort(token, kind="stable")
            token, owner = token[order], owner[order]
            new = np.append(True, token[1:] != token[:-1])
            many = np.diff(np.append(np.flatnonzero(new), len(token)))
            own = np.bincount(owner[np.repeat(many > 1, many)], minlength=len(names))
            token, owner = token[new], np.where(many > 1, -1, owner[new])
            part = (token >> np.uint64(32)).astype(np.int64) % parts
            order = np.argsort(part, kind="stable")
            part, token, owner = part[order], token[order].astype(np.uint32), owner[order]
            cuts = np.flatnonzero(np.diff(part)) + 1
            rows: list[tuple[int, bytes | None, bytes, bytes]] = []
            for x, y in zip([0, *cuts.tolist()], [*cuts.tolist(), len(part)], strict=True):
                used, place = np.unique(owner[x:y], return_inverse=True)
                place = place.astype(np.uint16 if len(used) <= 1 << 16 else np.uint32)
                rows.append((int(part[x]), token[x:y].tobytes(), place.tobytes(), np.where(used < 0, 0, names[used]).tobytes()))
            some = np.flatnonzero(own)
            rows.append((int(names[0] % parts), None, own[some].tobytes(), names[some].tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), *[pa.binary()] * 3), strict=True)], ["part", "tokens", "places", "names"])

        for batch in slices(batches, 1, _SLICE):
            found, at = shingle_sets(batch.column(1))
            sizes = np.diff(at)
            first = np.arange(len(found)) - np.repeat(at[:-1], sizes) < np.repeat(sizes - _ceil_percent(PERCENT, sizes) + _ceil_percent(SORTING, sizes), sizes)
            owner = np.zeros(len(sizes), np.int64)
            for d in np.flatnonzero(sizes).tolist():
                node = xxhash.xxh3_128_digest(found[at[d] : at[d + 1]].tobytes())
                owner[d] = -1 if node in seen else seen.setdefault(node, len(seen))
            owner = np.repeat(owner, sizes)
            first &= owner >= 0
            held.append((_mix(found[first] * _MULTIPLIERS[2]), owner[first]))
            count += int(first.sum())
            if count > _FLUSH or len(seen) > 60_000:
                yield flush()
                held, seen, count = [], {}, 0
        if count:
            yield flush()

    def of_part(blobs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        lists = [b for b in blobs if b[0] is not None]
        names = [np.frombuffer(b[2], np.int64) for b in blobs if b[0] is None]
        times = [np.frombuffer(b[1], np.int64) for b in blobs if b[0] is None]
        if lists:
            token = np.concatenate([np.frombuffer(b[0], np.uint32) for b in lists])
            # A shingle has 4 bytes, the place of its owner 2 or 4.
            name = np.concatenate([np.frombuffer(b[2], np.int64)[np.frombuffer(b[1], np.uint16 if 2 * len(b[1]) == len(b[0]) else np.uint32)] for b in lists])
            order = np.lexsort((name, token))
            token, name = token[order], name[order]
            same = (token[1:] == token[:-1]) & (name[1:] != name[:-1])
            begins = np.append(True, token[1:] != token[:-1])
            run_of = np.cumsum(begins) - 1
            shared = np.bincount(run_of[1:][same], minlength=run_of[-1] + 1) > 0
            shared |= np.bincount(run_of[name == 0], minlength=run_of[-1] + 1) > 0
            name = name[shared[run_of] & (name != 0)]
            names.append(name)
            times.append(np.ones(len(name), np.int64))
        return added(np.concatenate(names), np.concatenate(times))

    def added(name: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        name, at = np.unique(name, return_inverse=True)
        return name, np.bincount(at, times, len(name)).astype(np.int64)

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[list[bytes]]]:
        group, blobs = None, []
        for batch in batches:
            for part, *blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group not in (None, part):
                    yield blobs
                    blobs = []
                group = part
                blobs.append(blob)
        if blobs:
            yield blobs

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blobs in groups(batches):
            name, times = of_part(blobs)
            to = (_mix(name.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            name, times, to = name[order], times[order], to[order]
            cuts = np.append(np.flatnonzero(np.append(True, np.diff(to) != 0)), len(to)) if len(to) else np.zeros(1, np.int64)
            rows = [(int(to[x]), name[x:y].tobytes(), times[x:y].tobytes()) for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["part", "names", "times"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blobs in groups(batches):
            columns = added(*(np.concatenate([np.frombuffer(b[i], np.int64) for b in blobs]) for i in (0, 1)))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["half", "times"])

    packed = doc_texts(docs).mapInArrow(pack, "part int, tokens binary, places binary, names binary")
    counted = packed.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(count, "part int, names binary, times binary")
    return counted.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(total, "half long, times long")


def sets_left(docs: DataFrame, members: DataFrame) -> DataFrame:
    """id, node, n, tokens (the sorted shingles as bytes), the least shingle by each of some hash functions, and the parity sketch, of each
    distinct set that meets others often enough to be linked. The written ids are what sets are called from then on."""
    spark = docs.sparkSession
    total = members.agg(F.sum("n_shingles")).first()[0] or 0
    parts = int(max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // (2 * _PART_TOKENS) + 1))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([_half(x) for x in batch.column(0).to_pylist()], pa.int64())], ["node", "key", "n", "half"])

    nodes = members.where("node is not null").groupBy("node").agg(F.min("key").alias("key"), F.first("n_shingles").alias("n"))
    nodes = nodes.mapInArrow(cut, "node binary, key binary, n long, half long")
    least = F.ceil(F.ceil(F.col("n") * PERCENT / 100) * SORTING / 100)
    owners = written(nodes.join(met_counts(docs, parts), "half").where(F.col("times") >= least).select("node", "key"), "owners")
    wanted = Filter.of(owners.select(F.xxhash64("key").alias("name")))

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.select([1, 2]).filter(pa.array(wanted.holds(batch.column(0).to_numpy().view(np.uint64))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, _SLICE):
            found, at = shingle_sets(batch.column(1))
            cuts = list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
            least = np.stack([np.minimum.reduceat(_mix(found * m), at[:-1]) for m in _MULTIPLIERS[:MEETINGS]], axis=1).view(np.int64)
            met = pa.ListArray.from_arrays(np.arange(len(cuts) + 1, dtype=np.int32) * MEETINGS, pa.array(least.ravel()))
            blobs = pa.array([found[x:y].tobytes() for x, y in cuts], pa.binary())
            sketch = pa.array([parities(found[x:y]) for x, y in cuts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(at)), blobs, met, sketch], ["node", "n", "tokens", "met", "sketch"])

    texts = doc_texts(docs).select(_row_key().alias("key"), "text").select(F.xxhash64("key").alias("name"), "key", "text").mapInArrow(thin, "key binary, text string")
    texts = texts.join(owners, "key").dropDuplicates(["key"]).select("node", "text")
    made = texts.mapInArrow(run, "node binary, n long, tokens binary, met array<long>, sketch binary")
    made = written(made.withColumn("id", F.monotonically_increasing_id()), "sets")
    discard(owners)
    return made


def components(edges: DataFrame) -> DataFrame:
    """id, component (the smallest id reachable) of every node of the edges (a, b), by alternating large and small
    stars: each round is two minima by node and two joins, and the number of rounds grows with the logarithm of the size."""
    stars = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    stars = written(stars, "stars")
    before = None
    while True:
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(low.where("a > low").select("a", F.col("low").alias("b"))).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").unionByName(least.select("a", F.col("low").alias("b"))).distinct()
        last, stars = stars, written(small, "stars")
        discard(last)
        now = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return stars.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(stars.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def compared(sets: DataFrame, pairs: DataFrame, differences: bool = False) -> DataFrame:
    """pairs (a, b) of ids with linked, whether the sets overlap enough. With differences also: e, h, as the module says with b as leader, and apart, the
    shingles that stand in one of both, as bytes.

    The sets of b's partners go to b, dealt out by a hash so that each task gets b's own set and about STAR partners, however many b has.
    """
    parts = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / STAR).cast("int").alias("parts"))
    partners = pairs.join(parts, "b").select("a", "b", F.pmod(F.xxhash64("a"), "parts").cast("int").alias("part"))
    partner_rows = partners.join(sets.select(F.col("id").alias("a"), "tokens"), "a").select("b", "part", "a", "tokens")
    centres = parts.select("b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    centre_rows = centres.join(sets.select(F.col("id").alias("b"), "tokens"), "b").select("b", "part", F.lit(None).cast("long").alias("a"), "tokens")
    schema = "a long, b long, linked boolean" + (", e long, h long, apart binary" if differences else "")
    types = [pa.int64(), pa.int64(), pa.bool_()] + [pa.int64(), pa.int64(), pa.binary()] * differences
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, own = None, None
        for batch in slices(batches, 3, _SLICE):
            out = []
            for b, part, a, blob in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                found = np.frombuffer(blob, np.uint64)
                if a is None:
                    centre, own = (b, part), found.copy()
                elif centre == (b, part):
                    if differences:
                        there, here = _shared(own, found), _shared(found, own)
                        p, q = int((~there).sum()), int((~here).sum())
                        e = 4 * p + 3 * q
                        out.append((a, b, e <= len(own), e, len(own), np.concatenate([own[~there], found[~here]]).tobytes()))
                    else:
                        out.append((a, b, linked(found, own)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    dealt = centre_rows.unionByName(partner_rows).repartition(F.col("b"), F.col("part")).sortWithinPartitions("b", "part", F.col("a").asc_nulls_first())
    return dealt.mapInArrow(run, schema)


def _likely(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b) without those that the sketches rule out."""
    own = lambda c: sets.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = (batch.column(2).to_numpy() + batch.column(3).to_numpy()).tolist()
            keep = [may_link(*row) for row in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), n, strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    rows = pairs.join(own("a"), "a").join(own("b"), "b").select("a", "b", "n_a", "n_b", "s_a", "s_b")
    return rows.mapInArrow(run, "a long, b long")


def _exploded(rows: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """A row for each of the 64-bit numbers packed in a column, token, with the columns to keep."""
    schema = rows.select(*keep).schema.add("token", "long")
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, len(keep), _SLICE):
            blobs = batch.column(len(keep)).to_pylist()
            at = pa.array(np.repeat(np.arange(len(blobs)), [len(b) // 8 for b in blobs]))
            token = pa.array(np.frombuffer(b"".join(blobs), np.int64))
            yield pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns[: len(keep)]), token], names)

    return rows.select(*keep, column).mapInArrow(run, schema)


def _first_lists(sets: DataFrame) -> DataFrame:
    """frame, token, id, n, e, h, place, linked, near: the inverted lists of sets over all but the most frequent shingles of each (frame 0: without a
    leader a set differs from nothing in all its n shingles, so e = 3n and h = 0). place: how many of the set's lists are as long or longer."""
    own = _exploded(sets, "tokens", ["id", "n"])
    many = own.groupBy("token").agg(F.count(F.lit(1)).alias("many")).where("many > 1")
    order = Window.partitionBy("id").orderBy(F.col("many").desc(), "token")
    skipped = F.ceil(F.col("n") * PERCENT / 100) - F.ceil(F.col("n") * FORMING / 100)
    ranked = own.join(many, "token").withColumn("place", F.row_number().over(order))
    return ranked.where(F.col("place") > skipped).select(F.lit(0).cast("long").alias("frame"), "token", "id", "n", (3 * F.col("n")).alias("e"), F.lit(0).cast("long").alias("h"), "place", F.lit(False).alias("linked"), F.lit(True).alias("near"))


def _difference_lists(framed: DataFrame, sets: DataFrame) -> DataFrame:
    """The inverted lists of differences from leaders (frame: the leader), over all but the most frequent ones of each set. A set that isn't linked
    with the leader has more lists in which to meet the linked ones; near marks those in which it can meet its like."""
    wanted = framed.where("not linked").select("b").distinct()
    rows = framed.join(wanted, "b", "left_semi").withColumn("size", F.octet_length("apart") / 8)
    unlike = F.floor((F.col("e") + 1 + 6) / 7)
    rows = rows.withColumn("like", unlike).withColumn("least", F.when(F.col("linked"), unlike).otherwise(F.greatest(F.lit(1), F.ceil((F.col("e") - F.col("h")) / 7))))
    own = _exploded(rows.where("size >= least"), "apart", ["a", "b", "e", "h", "linked", "like", "least"])
    many = own.groupBy("b", "token").agg(F.count(F.lit(1)).alias("many"), F.max(~F.col("linked")).alias("any")).where("many > 1 and any")
    order = Window.partitionBy("a", "b").orderBy(F.col("many").desc(), "token")
    ranked = own.join(many, ["b", "token"]).withColumn("place", F.row_number().over(order)).where("place >= least")
    found = ranked.select(F.col("b").alias("frame"), "token", F.col("a").alias("id"), "e", "h", "place", "linked", (F.col("place") >= F.col("like")).alias("near"))
    return found.join(sets.select("id", "n"), "id").select("frame", "token", "id", "n", "e", "h", "place", "linked", "near")


def _split(lists: DataFrame, groups: DataFrame) -> DataFrame:
    """lists with long: whether a list has more than LONG_LIST pairs of different components for each of its sets; and blocks: how many it is dealt into
    if it is paired. Lists of one component go."""
    rows = lists.join(groups, "id", "left").withColumn("component", F.coalesce("component", "id"))
    each = rows.groupBy("frame", "token", "component").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("near") & ~F.col("linked")).alias("near"), F.count_if(~F.col("linked")).alias("free"))
    sums = each.groupBy("frame", "token").agg(
        F.sum("n").alias("all"), F.sum("near").alias("all_near"), F.sum("free").alias("all_free"),
        F.sum(F.col("near") * F.col("near")).alias("same_near"), F.sum(F.col("free") * (F.col("n") - F.col("free"))).alias("same_apart"), F.count(F.lit(1)).alias("components"),
    )
    pairs = (F.col("all_near") * F.col("all_near") - F.col("same_near")) / 2 + F.col("all_free") * (F.col("all") - F.col("all_free")) - F.col("same_apart")
    blocks = F.ceil(F.col("all") / BLOCK).cast("int").alias("blocks")
    return lists.join(sums.where("components > 1").select("frame", "token", (pairs > LONG_LIST * F.col("all")).alias("long"), blocks), ["frame", "token"])


def _pairs(lists: DataFrame, groups: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets of different components that meet in lists often enough. In the first lists that two sets share, as many as they must meet in, those as
    long or longer of either bound how many more they can share: meetings for which that is too little aren't formed."""
    rows = lists.join(groups, "id", "left").withColumn("component", F.coalesce("component", "id"))
    every, own = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)), F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    left, right = (
        rows.select("frame", "token", x.alias("x"), y.alias("y"), *(F.col(c).alias(f"{c}_{s}") for c in ("id", "n", "e", "h", "place", "linked", "near", "component")))
        for s, x, y in (("a", own, every), ("b", every, own))
    )
    fits = (100 * F.col("n_a") >= PERCENT * F.col("n_b")) & (100 * F.col("n_b") >= PERCENT * F.col("n_a"))
    meets = (~F.col("linked_a") & ~F.col("linked_b") & F.col("near_a") & F.col("near_b")) | (F.col("linked_a") != F.col("linked_b"))
    times = F.when(F.col("frame") == 0, F.ceil(F.least("n_a", "n_b") * FORMING / 100)).otherwise(1)
    enough = 7 * (F.least("place_a", "place_b") + times - 1) >= F.col("e_a") + F.col("e_b") - F.col("h_a")
    met = left.join(right, ["frame", "token", "x", "y"]).where((F.col("component_a") < F.col("component_b")) & fits & meets & enough)
    met = met.groupBy("frame", F.col("id_a").alias("a"), F.col("id_b").alias("b")).agg(F.count(F.lit(1)).alias("met"), F.first(times).alias("times"))
    return met.where("met >= times").select("a", "b")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every document, as _found says."""
    return _found(docs).select("doc_id", "n_shingles", "component_id")


def _merged(sets: DataFrame, groups: DataFrame, bound: DataFrame) -> DataFrame:
    """groups (id, component) of all sets after links (a, b) to leaders: what is linked with one leader's component becomes one with it. Links of links
    are left for the end, as components only save work until then."""
    own = written(sets.select("id").join(groups, "id", "left").select("id", F.coalesce("component", "id").alias("component")), "groups")
    of = lambda c: own.select(F.col("id").alias(c), F.col("component").alias(f"c_{c}"))
    met = written(bound.join(of("a"), "a").join(of("b"), "b").where("c_a <> c_b").select("c_a", "c_b").distinct(), "met")
    low = met.groupBy("c_b").agg(F.least(F.min("c_a"), F.col("c_b")).alias("low"))
    to = met.join(low, "c_b").select(F.col("c_a").alias("component"), "low").unionByName(low.select(F.col("c_b").alias("component"), "low"))
    to = to.groupBy("component").agg(F.min("low").alias("low"))
    return own.join(to, "component", "left").select("id", F.coalesce("low", "component").alias("component"))


def _links(sets: DataFrame) -> DataFrame:
    """Links (a, b) between ids that give all components of the sets."""
    met = sets.select("id", F.posexplode("met").alias("kind", "key"))
    hubs = met.groupBy("kind", "key").agg(F.min("id").alias("hub"), F.max("id").alias("high")).where("hub <> high").drop("high")
    votes = met.join(hubs, ["kind", "key"]).where("id <> hub").groupBy("id", "hub").agg(F.count(F.lit(1)).alias("votes"))
    best = votes.groupBy("id").agg(F.max(F.struct("votes", "hub")).alias("best")).select(F.col("id").alias("a"), F.col("best.hub").alias("b"))
    links = written(compared(sets, best).where("linked").select("a", "b"), "links")
    # A hub has a smaller id than what is bound to it: what a hub is bound to in turn, seen twice over, is a component good enough to save work.
    up = links.select(F.col("a").alias("b"), F.col("b").alias("top"))
    twice = links.join(up, "b", "left").select("a", F.coalesce("top", "b").alias("b")).join(up, "b", "left")
    groups = written(twice.select(F.col("a").alias("id"), F.coalesce("top", "b").alias("component")), "groups")
    popular = written(links.groupBy(F.col("b").alias("id")).agg(F.count(F.lit(1)).alias("bound")), "popular")
    lists, short = written(_split(_first_lists(sets), groups), "lists"), []
    for level in range(LEVELS + 1):
        short.append(lists.where("not long") if level < LEVELS else lists)
        long = lists.where("long").select("frame", "token", "id", "n")
        if level == LEVELS or long.isEmpty():
            break
        # The set with the fewest shingles of its own is nearest to what the others were copied from.
        own = lists.groupBy("id").agg(F.max("place").alias("met")).join(popular, "id", "left")
        rank = F.struct((F.col("met") - F.col("n")).alias("own"), F.coalesce("bound", F.lit(0)).alias("bound"), F.xxhash64("id", F.lit(level)).alias("by"), "id")
        leaders = long.join(own, "id").groupBy("frame", "token").agg(F.max(rank).alias("leader"))
        led = long.join(leaders, ["frame", "token"]).select(F.col("id").alias("a"), F.col("leader.id").alias("b")).where("a <> b").distinct()
        framed = written(compared(sets, led, differences=True), "framed")
        bound = framed.where("linked").select("a", "b")
        links, groups = links.unionByName(bound), written(_merged(sets, groups, bound), "groups")
        lists = written(_split(_difference_lists(framed, sets), groups), "lists")
    pairs = None
    for part in short:
        found = _pairs(part.drop("long"), groups)
        pairs = found if pairs is None else pairs.unionByName(found)
    likely = written(_likely(pairs.distinct(), sets), "likely")
    return links.unionByName(compared(sets, likely).where("linked").select("a", "b"))


def _found(docs: DataFrame) -> DataFrame:
    """doc_id, key, component (of nodes), n_shingles, component_id of every document; component_id is the smallest doc_id reachable by links.

    Null and empty texts, and those without words, have no shingles and are linked with nothing. Equal sets are
    one node from the start. A row without a doc_id takes the component of what it is linked with (null if none has one);
    rows that repeat a doc_id with other texts each keep their own set. Ties don't arise; an empty table gives no rows.
    A very long text is a set like any other: its shingles are sorted in one task and its lists spread over the cluster.
    """
    members = written(members_of(docs), "members")
    sets = sets_left(docs, members)
    groups = written(components(_links(sets)), "groups")
    name = sets.select("id", "node")
    groups = groups.join(name, "id").join(name.select(F.col("id").alias("component"), F.col("node").alias("head")), "component").select("node", "head")
    named = members.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    named = named.join(groups, "node", "left").select("node", "doc_id", F.coalesce("head", "node").alias("component"))
    smallest = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    found = named.join(smallest, "component").select("node", "component", "component_id")
    return members.join(found, "node", "left").select("doc_id", "key", "component", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs without the near duplicates of others: of each component one of the rows with the smallest doc_id. Rows that
    repeat a doc_id with other texts stay or go by their own component. Rows without a doc_id stay. All columns stay."""
    found = written(_found(docs).select("doc_id", "key", "component_id", F.coalesce("component", "key").alias("group")), "found")
    least = found.where("doc_id = component_id")
    stays = least.groupBy("group", "doc_id").agg(F.min("key").alias("first"), F.max("key").alias("last"))
    others = least.join(stays.where("first <> last"), ["group", "doc_id"]).where("key <> first").select("key")
    dropped = found.where("doc_id <> component_id").select("key").unionByName(others).distinct()
    repeated = least.groupBy("key").count().where("count > 1").select("key")
    own = "_row_key_"
    kept = docs.withColumn(own, _row_key()).join(dropped.withColumnRenamed("key", own), own, "left_anti")
    repeated = repeated.withColumnRenamed("key", own)
    single = kept.join(repeated, own, "left_anti").select(*docs.columns)
    again = kept.join(repeated, own, "left_semi").dropDuplicates([own]).select(*docs.columns)
    return single.unionByName(again)


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query over every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))
