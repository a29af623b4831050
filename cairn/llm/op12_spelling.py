"""Spelling variants: words one edit apart, and for each word the far more frequent word that it is a slip of.

Two words, the longer of L code points, are one edit apart if their common prefix and common suffix together reach L - 1. Blocks of words
are padded to code-point matrices, aligned at their starts and at their ends, and compared pair by pair, a column at a time: dense tiles.

Which words share a tile: if their common prefix has p code points, the edit stands at p of the longer word, and all before and behind it is the same in
both. So tiles are made by what stands outside an interval of places, [0, L/2) and [L/2, L) at first; a pair is looked at where the interval holds p, once.
Where too many words agree outside an interval, the interval is halved and they are dealt again; at an interval of one place
no more words than there are letters, and one, can agree. So no tile is large, however many words begin or end alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.shared import discard, doc_texts, table, written

RUN = "[A-Za-z\\u00C0-\\u00FF]+"
SLIP, LEAST_LENGTH, LEAST_N, TIMES = 31, 7, 2, 10
#: Code points of a tile's words, unless its interval is a single place.
TILE_CELLS = 1 << 14
#: Cells of a comparison at a time.
_CELLS = 1 << 20


def words(docs: DataFrame, slip: int = SLIP, least_length: int = LEAST_LENGTH, least_n: int = LEAST_N) -> DataFrame:
    """word, n: lower-cased runs of letters, with the code point that the checksum of a run names deleted in one of `slip` of them."""
    runs = doc_texts(docs).select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    # A run that is too short now is too short after a deletion as well.
    lower = runs.where(F.length("run") >= least_length).select("doc", F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("run"))
    named = lower.withColumn("h", F.crc32(F.encode(F.concat("doc", F.lit(":"), "run"), "UTF-8")))
    cut = F.expr("concat(substring(run, 1, cast(h % length(run) as int)), substring(run, cast(h % length(run) as int) + 2))")
    word = named.select(F.when(F.col("h") % slip == 0, cut).otherwise(F.col("run")).alias("word"))
    return word.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_n)


def _padded(found: list[str], width: int, right: bool) -> np.ndarray:
    """Code points, a row a word, a column a place from the start (or, right, from the end)."""
    out = np.zeros((len(found), width), np.int32)
    for i, word in enumerate(found):
        points = np.frombuffer(word.encode("utf-32-le"), np.int32)
        out[i, : len(points)] = points[::-1] if right else points
    return out


def tile_pairs(found: list[str], longer: int, first: int, last: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i < j) of distinct words of length `longer` or one less, one edit apart, of which one at least has length `longer`
    and whose common prefix has from `first` to `last` - 1 code points. Block by block."""
    size = np.array([len(w) for w in found])
    left, right = _padded(found, longer, False), _padded(found, longer, True)
    step = max(1, _CELLS // max(1, len(found)))
    for at in range(0, len(found), step):
        rows = slice(at, min(at + step, len(found)))
        n, others = rows.stop - at, slice(at, len(found))
        shape = (n, len(found) - at)
        counts = []
        for points in (left, right):
            run, length = np.ones(shape, bool), np.zeros(shape, np.int32)
            for c in range(longer):
                run &= (points[rows, c, None] == points[None, others, c]) & (points[rows, c, None] > 0)
                if not run.any():
                    break
                length += run
            counts.append(length)
        prefix, suffix = counts
        near = (prefix + suffix >= longer - 1) & (prefix >= first) & (prefix < last)
        near &= np.maximum(size[rows, None], size[None, others]) == longer
        near &= np.arange(n)[:, None] < np.arange(shape[1])[None, :]
        i, j = np.nonzero(near)
        yield i + at, j + at


def _keyed(df: DataFrame) -> DataFrame:
    """With a 128-bit name of what stands outside [first, last) of the longer word."""
    outside = "concat(substring(word, 1, first), '\\n', substring(word, length(word) - (longer - last) + 1))"
    return df.select("longer", "first", "last", F.expr(f"xxhash64({outside})").alias("key1"), F.expr(f"xxhash64(1, {outside})").alias("key2"), "word", "n")


def _best(rows: DataFrame) -> DataFrame:
    """Of each word: how many near words, the largest n of one, and the first in code-point order of those."""
    return rows.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("best"))


def _compared(tiles: DataFrame) -> DataFrame:
    """A row for each word of a tile that has near words in it, pre-aggregated: word, near, best, best_n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, rows = None, []

        def settle() -> pa.RecordBatch | None:
            if len(rows) < 2:
                return None
            found, n = [w for w, _ in rows], np.array([c for _, c in rows])
            # Places in the order (largest n, smallest word): the best near word is the smallest place.
            place = np.empty(len(rows), np.int64)
            order = sorted(range(len(rows)), key=lambda i: (-n[i], found[i]))
            place[order] = np.arange(len(rows))
            near, best = np.zeros(len(rows), np.int64), np.full(len(rows), len(rows), np.int64)
            for i, j in tile_pairs(found, *tile[:3]):
                for a, b in ((i, j), (j, i)):
                    near += np.bincount(a, minlength=len(rows))
                    np.minimum.at(best, a, place[b])
            at = np.flatnonzero(near)
            chosen = [order[k] for k in best[at].tolist()]
            return pa.RecordBatch.from_arrays(
                [pa.array([found[k] for k in at.tolist()], pa.string()), pa.array(near[at]), pa.array([found[k] for k in chosen], pa.string()), pa.array(n[chosen].astype(np.int64))],
                ["word", "near", "best", "best_n"],
            )

        for batch in batches:
            heads = zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True)
            for head, word, n in zip(heads, batch.column(5).to_pylist(), batch.column(6).to_pylist(), strict=True):
                if head != tile:
                    done = settle()
                    if done is not None and done.num_rows:
                        yield done
                    tile, rows = head, []
                rows.append((word, n))
        done = settle()
        if done is not None and done.num_rows:
            yield done

    columns = ["longer", "first", "last", "key1", "key2"]
    return tiles.repartition(*columns).sortWithinPartitions(*columns).mapInArrow(run, "word string, near long, best string, best_n long")


def near_words(counted: DataFrame, tile_cells: int = TILE_CELLS) -> DataFrame:
    """word, n_near, best (struct: n, negative, and word): near words of each word that has any. counted: word (distinct), n."""
    ends = F.explode(F.array(F.length("word"), F.length("word") + 1)).alias("longer")
    halves = "explode(array(struct(0 as first, cast(ceil(longer / 2) as int) as last), struct(cast(ceil(longer / 2) as int) as first, longer as last)))"
    dealt = _keyed(counted.select("word", "n", ends).select("word", "n", "longer", F.expr(halves).alias("part")).select("word", "n", "longer", "part.first", "part.last"))
    found, keys, used = [], ["longer", "first", "last", "key1", "key2"], []
    while True:
        dealt = written(dealt, "op12-tiles")
        used.append(dealt)
        sizes = dealt.groupBy(*keys).agg(F.count("*").alias("size"), F.max(F.length("word")).alias("most")).where("size > 1 and most = longer")
        sizes = written(sizes, "op12-sizes")
        used.append(sizes)
        fits = (F.col("size") * F.col("longer") <= tile_cells) | (F.col("last") - F.col("first") <= 1)
        small = sizes.where(fits).select(*keys)
        found.append(_compared(dealt.join(small, keys, "left_semi")))
        large = sizes.where(~fits).select(*keys)
        if large.isEmpty():
            break
        again = dealt.join(large, keys, "left_semi").withColumn("middle", F.expr("cast((first + last) div 2 as int)"))
        parts = F.expr("explode(array(struct(first, middle as last), struct(middle as first, last)))").alias("part")
        dealt = _keyed(again.select("word", "n", "longer", parts).select("word", "n", "longer", "part.first", "part.last"))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    out = written(_best(every), "op12-near")
    discard(*used)
    return out


def variants(counted: DataFrame, times: int = TIMES, tile_cells: int = TILE_CELLS) -> DataFrame:
    """word, n, form, form_n, n_near, root for each word of counted: word (distinct, not null), n.

    A form is the near word of largest n (ties: smallest in code-point order), where that n is `times` the word's at least. A root is
    reached by following forms: as n grows tenfold at each step, twenty steps lead to the last; each round doubles what has been walked. An empty table gives
    no rows; a word without near words has n_near 0, no form, and is its own root. Words of any length are compared whole.
    """
    near = near_words(counted, tile_cells)
    joined = counted.join(near, "word", "left")
    is_form = -F.col("best.n") >= F.col("n") * times
    base = written(
        joined.select("word", "n", F.when(is_form, F.col("best.word")).alias("form"), F.when(is_form, -F.col("best.n")).alias("form_n"), F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near")),
        "op12-forms",
    )
    walked = base.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        further = walked.select(F.col("word").alias("at"), F.col("root").alias("next"))
        stepped = written(walked.join(further, F.col("root") == F.col("at"), "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "op12-roots")
        walked = stepped.select("word", "root")
        if stepped.where("moved").isEmpty():
            break
    return base.join(walked, "word", "left").select("word", "n", "form", "form_n", "n_near", F.coalesce("root", "word").alias("root"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: the words of all documents. A null text has no words; a null doc_id stands as nothing before the colon of the
    checksum; rows that repeat count each; other columns are ignored."""
    return variants(written(words(table(spark, sf_dir, "documents")), "op12-words"))
