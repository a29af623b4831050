"""Hard negatives by an inverted multi-index: rows of other labels whose score stands in a window below a positive's.

Each block of vectors has an index: the two halves of its vectors have a codebook each, and a row's cell is its pair of codes. By the
Cauchy-Schwarz inequality no half of a row scores more than its code's score plus the query's norm times the code's radius, so the sum of both
bounds a cell. A heap walks the pairs of codes, each half sorted by its bound, in falling order of the sum; rows of visited cells are scored
exactly. A window is certified, and needs no more cells, when the next bound is below its floor, or below the last of the rows that it wants.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.llm.shared import table, written

SCALE, EVERY = 256, 100
POSITIVES, NEGATIVES = 5, 10
#: Percent of the positive's score, at least and at most.
LOW, HIGH = 30, 90
BLOCK_ROWS = 1 << 15
#: Codes of a half at most; rows of a block that its codebooks are fitted on at most (all rows are indexed); rounds of fitting.
CODES, FIT_ROWS, ROUNDS = 32, 4096, 6
#: Components are held to this, so that the scores of 512 of them fit 64 bits.
MOST = 1 << 27
#: Rows that are scored at once, at least.
_AT_ONCE = 256


def _nearest(x: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return np.argmin((codes**2).sum(axis=1)[None, :] - 2 * (x @ codes.T), axis=1)


def _codebook(x: np.ndarray, codes: int) -> np.ndarray:
    """Lloyd's algorithm on at most FIT_ROWS evenly spaced rows."""
    some = np.unique(x[:: -(-len(x) // FIT_ROWS)], axis=0)
    centers = some[:: -(-len(some) // codes)].copy()
    for _ in range(ROUNDS):
        near = _nearest(some, centers)
        sums, n = np.zeros_like(centers), np.bincount(near, minlength=len(centers))
        np.add.at(sums, near, some)
        centers[n > 0] = sums[n > 0] / n[n > 0, None]
    return centers


class MultiIndex:
    """Rows by cell: a pair of codes, one for each half of the vector."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, codes: int = CODES):
        codes = max(1, min(codes, int(np.sqrt(len(ids) / 8))))
        middle = vectors.shape[1] // 2
        self.halves, code_of = [], []
        for part in (slice(0, middle), slice(middle, None)):
            x = vectors[:, part].astype(np.float64)
            centers = _codebook(x, codes) if x.shape[1] else np.zeros((1, 0))
            near = _nearest(x, centers)
            radius = np.zeros(len(centers))
            np.maximum.at(radius, near, np.sqrt(((x - centers[near]) ** 2).sum(axis=1)))
            self.halves.append((part, centers, radius))
            code_of.append(near)
        self.wide = len(self.halves[1][1])
        cell = code_of[0] * self.wide + code_of[1]
        order = np.lexsort((ids, cell))
        self.ids, self.labels, self.vectors = ids[order], labels[order], vectors[order]
        self.first = np.searchsorted(cell[order], np.arange(len(self.halves[0][1]) * self.wide + 1))

    def cells(self, query: np.ndarray) -> Iterator[tuple[float, float, int]]:
        """Cells that hold rows, in falling order of the bound: the most that a row can score, the least, the cell."""
        most, least, order = [], [], []
        for part, centers, radius in self.halves:
            q = query[part].astype(np.float64)
            score, room = centers @ q, np.sqrt(q @ q) * radius
            slack = 1e-9 * (np.abs(centers) @ np.abs(q) + room) + 1e-6
            most.append(score + room + slack)
            least.append(score - room - slack)
            order.append(np.argsort(-most[-1], kind="stable"))
        (a, b), (x, y) = order, most
        heap = [(-(x[a[0]] + y[b[0]]), 0, 0)]
        while heap:
            bound, i, j = heapq.heappop(heap)
            # (i, j) is pushed once: by (i, j - 1), or by (i - 1, 0) in the first column.
            if j + 1 < len(b):
                heapq.heappush(heap, (-(x[a[i]] + y[b[j + 1]]), i, j + 1))
            if j == 0 and i + 1 < len(a):
                heapq.heappush(heap, (-(x[a[i + 1]] + y[b[0]]), i + 1, 0))
            cell = int(a[i] * self.wide + b[j])
            if self.first[cell] < self.first[cell + 1]:
                yield -bound, float(least[0][a[i]] + least[1][b[j]]), cell

    def search(self, query: np.ndarray, own: int, label: int, same: bool, windows: list[tuple[int, int]], k: int) -> list[list[tuple[int, int]]]:
        """For each window of scores, its ends included, the k first (score falling, id rising) of the other rows of the same label, or of other labels: (id, score)."""
        best: list[list[tuple[int, int]]] = [[] for _ in windows]
        open_ = [w for w, (low, high) in enumerate(windows) if low <= high]
        waiting: list[int] = []

        def settle() -> None:
            at = np.concatenate([np.arange(self.first[c], self.first[c + 1]) for c in waiting])
            at = at[(self.ids[at] != own) & ((self.labels[at] == label) == same)]
            scores = self.vectors[at] @ query
            for w in open_:
                low, high = windows[w]
                inside = np.flatnonzero((scores >= low) & (scores <= high))
                if len(inside) > k:  # no more than the k-th score and its ties are sorted
                    bar = np.partition(scores[inside], len(inside) - k)[len(inside) - k]
                    inside = inside[scores[inside] >= bar]
                chosen = inside[np.lexsort((self.ids[at[inside]], -scores[inside]))[:k]]
                best[w] = sorted(best[w] + list(zip(self.ids[at[chosen]].tolist(), scores[chosen].tolist(), strict=True)), key=lambda r: (-r[1], r[0]))[:k]
            waiting.clear()

        def certified(w: int, bound: float) -> bool:
            return bound < windows[w][0] or len(best[w]) == k and bound < best[w][-1][1]

        for bound, least, cell in self.cells(query):
            still = [w for w in open_ if not certified(w, bound)]
            if len(still) < len(open_) and waiting:
                settle()  # rows that wait may be in a window that needs no further cells
                still = [w for w in still if not certified(w, bound)]
            open_ = still
            if not open_:
                break
            if least > max(windows[w][1] for w in open_):
                continue
            waiting.append(cell)
            if sum(int(self.first[c + 1] - self.first[c]) for c in waiting) >= _AT_ONCE:
                settle()
        if waiting and open_:
            settle()
        return best


def _finite(v: Column) -> Column:
    return F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def _rows(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id, label, v, of the rows that take part."""
    whole = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & _finite(F.col("embedding")))
    number = F.transform("embedding", lambda x: F.greatest(F.least(F.floor(x.cast("double") * scale), F.lit(MOST)), F.lit(-MOST)).cast("long"))
    return whole.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), number.alias("v"))


def _ask(rows: DataFrame, asked: DataFrame, same: bool, k: int, block_rows: int) -> DataFrame:
    """asked: vec_id, label, v, windows (array of low, high). anchor, label, mark, window (number), id, score: from each block k rows of a window."""
    blocks = max(1, -(-rows.count() // block_rows))
    lot = F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int")
    none = F.lit(None).cast("array<struct<low:long,high:long>>")
    stored = rows.select(lot.alias("block"), F.size("v").alias("size"), F.lit(False).alias("asks"), "vec_id", "label", "v", none.alias("windows"), F.lit(0).cast("long").alias("mark"))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    copies = asked.select(every.alias("block"), F.size("v").alias("size"), F.lit(True).alias("asks"), "vec_id", "label", "v", "windows", F.xxhash64("v").alias("mark"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, parts, index = None, [], None
        for batch in batches:
            out: list[tuple] = []
            block, size, asks = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            ids, labels, marks = (batch.column(i).to_numpy() for i in (3, 4, 7))
            offsets, values = batch.column(5).offsets.to_numpy(), batch.column(5).values.to_numpy()
            cuts = np.flatnonzero((np.diff(block) != 0) | (np.diff(size) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(block)], strict=True):
                if a == b:
                    continue
                found = values[offsets[a] : offsets[b]].reshape(b - a, int(size[a]))
                if group != (block[a], size[a]):
                    group, parts, index = (block[a], size[a]), [], None
                if not asks[a]:
                    parts.append((ids[a:b].copy(), labels[a:b].copy(), found.copy()))
                    continue
                if index is None and parts:
                    index, parts = MultiIndex(*(np.concatenate(p) for p in zip(*parts, strict=True))), []
                if index is None:
                    continue
                wanted = batch.column(6).slice(a, b - a).to_pylist()
                for own, label, mark, vector, windows in zip(ids[a:b].tolist(), labels[a:b].tolist(), marks[a:b].tolist(), found, wanted, strict=True):
                    best = index.search(vector, own, label, same, [(w["low"], w["high"]) for w in windows], k)
                    out += [(own, label, mark, w, i, s) for w, rows_ in enumerate(best) for i, s in rows_]
            if out:
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["anchor", "label", "mark", "window", "id", "score"])

    dealt = stored.unionByName(copies).repartition(blocks, "block").sortWithinPartitions("block", "size", "asks")
    return dealt.mapInArrow(run, "anchor long, label long, mark long, window long, id long, score long")


def hard_negatives(vectors: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. vectors: vec_id, label, embedding; `anchors` picks the anchors.

    Components become floor(scale * x), held to +-MOST. A score is the integer inner product; higher come first, ties by smaller vec_id. For each anchor
    and each of its first `positives` other rows of its label: the first `negatives` rows of other labels with low * positive score <= 100 * score <=
    high * positive score. A positive with a score below 0 has an empty window.

    Rows without a vec_id or label, and vectors that are null or hold null or non-finite components, take no part; vectors meet only others of their length, and empty
    ones score 0. Rows that repeat count each as candidates (never as their own: other rows are those of another vec_id), equal rows once as an anchor; a vec_id that repeats
    with another vector or label is asked for each. An empty table gives no rows.

    Vectors are dealt into blocks by a hash of their row, and every block is asked for all anchors, which stream past its index.
    """
    rows = _rows(vectors, scale)
    asked = written(rows.where(anchors).distinct(), "op11-anchors")
    everything = F.array(F.struct(F.lit(-(1 << 63)).alias("low"), F.lit((1 << 63) - 1).alias("high")))
    key = ["anchor", "label", "mark"]
    order = [F.col("score").desc(), F.col("id")]
    near = _ask(rows, asked.withColumn("windows", everything), True, positives, block_rows)
    chosen = near.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("rank") <= positives)
    chosen = written(chosen.select(*key, (F.col("rank") - 1).cast("long").alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "op11-positives")
    # 100 * score >= low * positive, and 100 * score <= high * positive, in whole numbers.
    part = lambda percent: F.col("positive_score").cast("decimal(20,0)") * F.lit(percent).cast("decimal(4,0)") / F.lit(100).cast("decimal(3,0)")
    window = F.struct(F.ceil(part(low)).cast("long").alias("low"), F.floor(part(high)).cast("long").alias("high"))
    windows = chosen.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("window", window.alias("w")))).alias("w")).select(*key, F.col("w.w").alias("windows"))
    asked = asked.select(F.col("vec_id").alias("anchor"), "label", F.xxhash64("v").alias("mark"), "v").join(windows, key).select(F.col("anchor").alias("vec_id"), "label", "v", "windows")
    far = _ask(rows, asked, False, negatives, block_rows)
    ranked = far.withColumn("rank", F.row_number().over(Window.partitionBy(*key, "window").orderBy(*order))).where(F.col("rank") <= negatives)
    return ranked.join(chosen, [*key, "window"]).select(
        F.col("anchor").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: anchors are the rows whose vec_id is divisible by 100; where it is divisible by 7, the label is first (label + 1) % 10."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("vec_id") % EVERY == 0)


ORACLE_SQL = f"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS other_id, a.label = c.label AS same,
         CAST(coalesce(list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id AND len(a.v) = len(c.v)
  WHERE a.vec_id % {EVERY} = 0
), p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= {POSITIVES}
)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)
QUALIFY row_number() OVER w <= {NEGATIVES}
"""
