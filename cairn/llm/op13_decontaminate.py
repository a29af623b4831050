"""Benchmark decontamination: an FM-index of each shard of the training texts, searched backward for the windows of the benchmark.

A task gathers the words of its documents into shards of at most SHARD_WORDS words, numbers a shard's words, sorts its suffixes and
keeps the transform in a wavelet matrix, with every SAMPLE-th text position at its row. All windows step backward together,
a word a step, each narrowing its range of rows by two ranks. What is left of a range are the occurrences; each walks to the next sampled row,
which tells its place. Places that touch merge into spans, within the document.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.shared import slices, table, text_or_empty

WINDOW = 10
#: Words, document ends and one terminal of a shard: a row, a rank and a place take 20 bits each.
SHARD_WORDS = (1 << 20) - 2
SAMPLE = 4
#: Bytes of windows that go to the tasks at once. More are searched in several passes.
BLOCK_BYTES = 32 << 20
#: Words of more bytes than this stand for themselves by a digest.
LONG_WORD = 64

#: Words of a text as it stands, and of a lower-cased one.
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_SQL_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes that stand in no word become blanks, A-Z become a-z; all bytes above 127 belong to words.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
_GAP = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
_PIECE = 4 << 20
_TERMINAL, _END, _FIRST = 0, 1, 2


class Bits:
    """A bit vector with ranks."""

    def __init__(self, bits: np.ndarray):
        packed = np.zeros(8 * (len(bits) // 64 + 1), np.uint8)
        some = np.packbits(bits, bitorder="little")
        packed[: len(some)] = some
        self.words = packed.view("<u8")
        self.before = np.zeros(len(self.words), np.int32)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Set bits before each place."""
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[at >> 6] + np.bitwise_count(self.words[at >> 6] & low)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1


class WaveletMatrix:
    """Ranks of symbols in a sequence: a bit vector a bit of the symbols, highest first, each level sorted by the bits above it."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels: list[tuple[int, Bits, int]] = []
        at = symbols
        for shift in range(max(1, (sigma - 1).bit_length()) - 1, -1, -1):
            bit = (at >> shift & 1).astype(bool)
            zeros = at[~bit]
            self.levels.append((shift, Bits(bit), len(zeros)))
            at = np.concatenate([zeros, at[bit]])
        self.start = np.zeros(sigma, np.int64)
        first = np.flatnonzero(np.diff(at, prepend=-1))
        self.start[at[first]] = first

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its place."""
        for shift, bits, zeros in self.levels:
            ones = bits.rank(at)
            at = np.where(symbols >> shift & 1, zeros + ones, at - ones)
        return at - self.start[symbols]

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and how often it stands before it."""
        symbols = np.zeros(len(at), np.int64)
        for shift, bits, zeros in self.levels:
            ones, bit = bits.rank(at), bits.get(at)
            symbols |= bit.astype(np.int64) << shift
            at = np.where(bit, zeros + ones, at - ones)
        return symbols, at - self.start[symbols]


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Places by the order of their suffixes. The last symbol is less than all others, and there are at most 2^20.

    Prefix doubling: only suffixes that share their first h symbols with others are sorted on, by the ranks h further.
    """
    n, mask = len(text), (1 << 20) - 1
    packed = np.sort(text.astype(np.int64) << 20 | np.arange(n))
    places, keys = packed & mask, packed >> 20
    rows, rank, h = np.arange(n), np.zeros(n, np.int64), 1
    order = places.copy()
    while True:
        new = np.ones(len(keys) + 1, bool)
        np.not_equal(keys[1:], keys[:-1], out=new[1:-1])
        starts = np.flatnonzero(new[:-1])
        rank[places] = rows[starts][np.cumsum(new[:-1]) - 1]
        shared = ~(new[:-1] & new[1:])
        rows = rows[shared]
        if not len(rows):
            return order
        places = order[rows]
        packed = np.sort(rank[places] << 40 | rank[places + h] << 20 | places)
        places, keys = packed & mask, packed >> 20
        order[rows] = places
        h *= 2


class FmIndex:
    """Of a text of symbols below sigma, without the terminal, which is 0."""

    def __init__(self, text: np.ndarray, sigma: int, sample: int = SAMPLE):
        text = np.append(text, _TERMINAL).astype(np.int32)
        order = suffix_array(text)
        self.less = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])[:-1]
        self.matrix = WaveletMatrix(text[order - 1], sigma)
        sampled = order % sample == 0
        self.sampled, self.samples, self.n = Bits(sampled), order[sampled], len(text)

    def ranges(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows, from and to, of the suffixes that begin with each phrase: backward search. Phrases are padded at their front by -1."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for step in range(phrases.shape[1] - 1, -1, -1):
            live = live[(phrases[live, step] >= 0) & (low[live] < high[live])]
            if not len(live):
                break
            symbols = phrases[live, step].astype(np.int64)
            low[live] = self.less[symbols] + self.matrix.rank(symbols, low[live])
            high[live] = self.less[symbols] + self.matrix.rank(symbols, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text's place of each row: steps back to a sampled row are counted."""
        places, left, steps = np.zeros(len(rows), np.int64), np.arange(len(rows)), 0
        rows = rows.copy()
        while len(left):
            here = self.sampled.get(rows)
            places[left[here]] = self.samples[self.sampled.rank(rows[here])] + steps
            left, rows = left[~here], rows[~here]
            symbols, before = self.matrix.access(rows)
            rows, steps = self.less[symbols] + before, steps + 1
        return places


def _canonical(word: bytes) -> bytes:
    return word if len(word) <= LONG_WORD else b"\0" + hashlib.sha256(word).hexdigest().encode()


class _Vocabulary(dict):
    def __missing__(self, word: bytes) -> int:
        name = _canonical(word)
        number = self[name] if name is not word and name in self else len(self) + _FIRST
        self[word] = number
        if name is not word:
            self.setdefault(name, number)
        return number


def _word_lists(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a text in lists, cut between words, so that a very long text isn't split at once."""
    at = 0
    while at < len(raw):
        end = at + _PIECE
        if end < len(raw):
            gap = _GAP.search(raw, end)
            end = gap.start() if gap else len(raw)
        yield raw[at:end].translate(_FOLD).split()
        at = end


class Windows:
    """Windows of a benchmark, with the item of each, as words numbered once."""

    def __init__(self, rows: list[tuple[list[str], str | None]], size: int):
        number: dict[bytes, int] = {}
        self.items = sorted({item for _, item in rows if item is not None})
        index = {item: i for i, item in enumerate(self.items)}
        keys: dict[tuple[int, ...], list[int]] = {}
        for words, item in rows:
            key = tuple(number.setdefault(w.encode(), len(number)) for w in words)
            found = keys.setdefault(key, [])
            if item is not None:
                found.append(index[item])
        self.words = list(number)
        self.lengths = np.array([len(k) for k in keys], np.int64)
        self.phrases = np.full((len(keys), size), -1, np.int32)
        for i, key in enumerate(keys):
            self.phrases[i, size - len(key) :] = key
        self.first = np.concatenate([[0], np.cumsum([len(v) for v in keys.values()], dtype=np.int64)]).astype(np.int64)
        self.owners = np.array([i for v in keys.values() for i in v], np.int64)


class _Shard:
    """Segments of documents that are indexed together."""

    def __init__(self, windows: Windows):
        self.windows = windows
        self.vocabulary = _Vocabulary()
        self.parts: list[np.ndarray] = []
        self.segments: list[tuple[int, int, int, int]] = []
        self.size = 0

    def add(self, doc: int, offset: int, ids: np.ndarray) -> None:
        """Words of a document from its word `offset` on."""
        self.segments.append((doc, offset, self.size, len(ids)))
        self.parts += [ids, np.array([_END])]
        self.size += len(ids) + 1

    def found(self) -> Iterator[tuple[int, list[tuple[int, int]], list[int]]]:
        """Of each segment with a hit: its document, spans of hit words within the document, and items."""
        known, w = self.vocabulary, self.windows
        names = np.array([known.get(word, -1) for word in w.words] + [-1], np.int64)
        phrases = names[w.phrases]
        able = np.flatnonzero((phrases >= 0).sum(axis=1) == w.lengths)
        if not len(able) or not self.segments:
            return
        index = FmIndex(np.concatenate(self.parts), len(known) + _FIRST)
        low, high = index.ranges(phrases[able])
        able, low, n = able[high > low], low[high > low], (high - low)[high > low]
        if not len(able):
            return
        which = np.repeat(able, n)
        rows = np.arange(len(which)) + np.repeat(low - (np.cumsum(n) - n), n)
        places = index.locate(rows)
        change = np.zeros(self.size + 1, np.int32)
        np.add.at(change, places, 1)
        np.add.at(change, places + w.lengths[which], -1)
        hit = np.cumsum(change[:-1]) > 0
        edge = np.flatnonzero(np.diff(hit, prepend=False, append=False)).reshape(-1, 2)
        starts = np.array([s[2] for s in self.segments])
        owner = np.searchsorted(starts, edge[:, 0], side="right") - 1
        at = np.unique(np.stack([np.searchsorted(starts, places, side="right") - 1, which]), axis=1)
        times = np.diff(w.first)[at[1]]
        items = w.owners[np.arange(times.sum()) + np.repeat(w.first[at[1]] - (np.cumsum(times) - times), times)]
        pair = np.unique(np.stack([np.repeat(at[0], times), items]), axis=1)
        for segment in np.unique(owner).tolist():
            doc, offset, start, _ = self.segments[segment]
            a, b = np.searchsorted(owner, [segment, segment + 1])
            c, d = np.searchsorted(pair[0], [segment, segment + 1])
            yield doc, (edge[a:b] + (offset - start)).tolist(), pair[1, c:d].tolist()


def _merged(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


_SPANS = "array<struct<first:long,last:long,start:long,end:long>>"
_SPAN_TYPE = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))


def _with_places(spans: list[list[int]], text: str) -> list[dict[str, int]]:
    """Spans of words, last exclusive, with the code points that they take in the text."""
    out, at = [], 0
    for number, word in enumerate(_WORD.finditer(text)):
        while at < len(spans) and number == spans[at][0]:
            out.append({"first": spans[at][0], "last": spans[at][1], "start": word.start(), "end": word.end()})
            at += 1
        if out and number < out[-1]["last"]:
            out[-1]["end"] = word.end()
    return out


def _search(texts: DataFrame, windows, size: int, shard_words: int) -> DataFrame:
    """texts: doc_id, text, key1, key2; windows: a broadcast Windows. n_words, and the spans and items of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []
        hits: dict[int, tuple[list, set]] = {}
        shard = _Shard(windows.value)

        def flush() -> None:
            nonlocal shard
            for doc, spans, items in shard.found():
                have = hits.setdefault(doc, ([], set()))
                have[0].extend(spans)
                have[1].update(items)
            shard = _Shard(windows.value)

        def out() -> pa.RecordBatch:
            ready, names = [], windows.value.items
            for number, (doc_id, key1, key2, n, raw) in enumerate(waiting):
                spans, items = hits.get(number, ([], set()))
                placed = _with_places(_merged(spans), raw.decode()) if spans else []
                ready.append((doc_id, key1, key2, n, placed, [names[i] for i in sorted(items)]))
            waiting.clear()
            hits.clear()
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), _SPAN_TYPE, pa.list_(pa.string()))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*ready, strict=True), types, strict=True)], ["doc_id", "key1", "key2", "n_words", "spans", "items"])

        for batch in slices(batches, most_bytes=_PIECE):
            ids, keys1, keys2 = (batch.column(i).to_pylist() for i in (0, 2, 3))
            for doc_id, raw, key1, key2 in zip(ids, batch.column(1).cast(pa.binary()).to_pylist(), keys1, keys2, strict=True):
                number, n, last, pieces = len(waiting), 0, [], []
                for words in _word_lists(raw):
                    while words:
                        room = shard_words - shard.size - sum(map(len, pieces)) - 1
                        if room <= 0:
                            shard.add(number, n - sum(map(len, pieces)), np.concatenate(pieces) if pieces else np.zeros(0, np.int32))
                            flush()
                            # Occurrences that go past the cut are found from the words before it.
                            pieces = [np.array([shard.vocabulary[w] for w in last], np.int32)]
                            continue
                        some, words = words[:room], words[room:]
                        pieces.append(np.fromiter(map(shard.vocabulary.__getitem__, some), np.int32, len(some)))
                        n += len(some)
                        last = (last + some[-(size - 1) :])[-(size - 1) :] if size > 1 else []
                if n:
                    shard.add(number, n - sum(map(len, pieces)), np.concatenate(pieces))
                waiting.append((doc_id, key1, key2, n, raw))
                if shard.size >= 0.9 * shard_words or len(waiting) >= 1 << 16:
                    flush()
                    yield out()
        if waiting:
            flush()
            yield out()

    return texts.mapInArrow(run, f"doc_id long, key1 long, key2 long, n_words long, spans {_SPANS}, items array<string>")


def _windows(benchmark: DataFrame, size: int) -> DataFrame:
    """item (as text), words: distinct windows of each item."""
    lower = F.translate(text_or_empty(), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    short = F.transform(F.regexp_extract_all(lower, F.lit(_SQL_WORD), F.lit(0)), lambda w: F.when(F.octet_length(w) > LONG_WORD, F.concat(F.lit("\0"), F.sha2(w, 256))).otherwise(w))
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), short.alias("words")).where(F.size("words") > 0)
    first = F.sequence(F.lit(1), F.greatest(F.size("words") - (size - 1), F.lit(1)))
    return items.select("item", "words", F.explode(first).alias("at")).select("item", F.slice("words", F.col("at"), size).alias("words")).distinct()


def _keyed(docs: DataFrame) -> DataFrame:
    text = text_or_empty()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("key1"), F.xxhash64(F.lit(1), text).alias("key2"))


def _hit_words(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, block_bytes: int = BLOCK_BYTES, shard_words: int = SHARD_WORDS) -> DataFrame:
    """doc_id, key1, key2 (name the text), n_words, spans, items: a row for each row of docs.

    docs: doc_id, text. benchmark: item_id, text. spans are the maximal runs of words covered by occurrences of windows: first and last
    word (last exclusive), start and end code point. items are the item_ids, as text, with an occurring window, sorted. A null or
    empty text has no words and no hits; an item without words has no window. An item without an item_id hits words and is no item; an item_id with several
    texts is one item. Rows that repeat count each; a doc_id may be null. An empty benchmark hits nothing, empty docs give no rows. Other columns are ignored. Texts of
    any length are cut at shards, with size - 1 words in common.

    Documents aren't shuffled. Windows reach the tasks in blocks of about block_bytes; a pass over docs is made for each block, and
    where there are several, their rows are merged by doc_id and text.
    """
    spark = docs.sparkSession
    asked = _windows(benchmark, size)
    blocks = max(1, -(-int(asked.agg(F.sum(F.expr("aggregate(words, 40L, (n, w) -> n + octet_length(w) + 8)"))).first()[0] or 0) // block_bytes))
    texts = _keyed(docs)
    passes = []
    for block in range(blocks):
        rows = [(r.words, r.item) for r in asked.where(F.pmod(F.xxhash64("words", "item"), F.lit(blocks)) == block).toLocalIterator()]
        passes.append(_search(texts, spark.sparkContext.broadcast(Windows(rows, size)), size, shard_words))
    if blocks == 1:
        return passes[0]
    every = passes[0]
    for found in passes[1:]:
        every = every.unionByName(found)
    hits = every.where(F.size("spans") > 0).select(F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("no_id"), "key1", "key2", "spans", "items").distinct()
    joined = (
        hits.groupBy("id", "no_id", "key1", "key2")
        .agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        .withColumn("spans", F.expr("""aggregate(spans, cast(array() as array<struct<first:bigint,last:bigint,start:bigint,end:bigint>>), (out, s) ->
            if(size(out) > 0 and s.first <= element_at(out, -1).last,
               concat(slice(out, 1, size(out) - 1), array(named_struct('first', element_at(out, -1).first, 'last', greatest(element_at(out, -1).last, s.last), 'start', element_at(out, -1).start, 'end', greatest(element_at(out, -1).end, s.end)))),
               concat(out, array(named_struct('first', s.first, 'last', s.last, 'start', s.start, 'end', s.end)))))"""))
    )
    base = passes[0].select("doc_id", "key1", "key2", "n_words", F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("no_id"))
    none = F.array().cast(_SPANS)
    return base.join(joined, ["id", "no_id", "key1", "key2"], "left").select(
        "doc_id", "key1", "key2", "n_words", F.coalesce("spans", none).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items")
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """docs with the spans cut out of the texts, from the first code point of a span's first word to the last of its last. Columns and rows stay; a null text stays null."""
    hits = contamination(docs, benchmark, size).where(F.size("spans") > 0).select("key1", "key2", "spans").distinct().withColumnsRenamed({"key1": "__key1", "key2": "__key2", "spans": "__spans"})
    keyed = docs.withColumns({"__key1": F.xxhash64(text_or_empty()), "__key2": F.xxhash64(F.lit(1), text_or_empty())})
    kept = F.expr("""if(__spans is null, text, concat(array_join(transform(__spans, (s, i) ->
        substring(text, if(i = 0, 0, __spans[i - 1].end) + 1, s.start - if(i = 0, 0, __spans[i - 1].end))), ''), substring(text, element_at(__spans, -1).end + 1)))""")  # fmt: skip
    return keyed.join(hits, ["__key1", "__key2"], "left").withColumn("text", kept).select(*(F.col(f"`{c}`") for c in docs.columns))


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: all documents against all items of the benchmark."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = _hit_words(F.col("spans"))
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), "spans",
    )
