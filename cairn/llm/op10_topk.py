"""Exact top-k by inner product over an impact-ordered index, a score at a time.

Each block of vectors has an index: for every dimension the vectors fall into segments of equal quantised value. A
query visits segments by descending impact, the least that a segment's vectors gain from it, and adds that to their
sums. What a vector can gain beyond its sum is bounded by what the segments still to come and the quantisation leave.
A vector is out only when its sum and that bound together miss the k-th largest sum; all others are scored exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.llm.shared import table

SCALE = 1024
EVERY = 100
TOP = 10
BLOCK_ROWS = 8192
LEVELS = 16
_STRIDE = 64


class ImpactIndex:
    """Segments of a block: for each dimension, vectors by quantised value."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, levels: int = LEVELS):
        self.ids, self.vectors = ids, vectors
        self.low, self.high = vectors.min(axis=0), vectors.max(axis=0)
        span = self.high - self.low + 1
        level = (vectors - self.low) * levels // span
        # The values of level j run from floor_[j] to floor_[j + 1] - 1.
        self.floor = self.low[:, None] + -(-np.arange(levels + 1)[None, :] * span[:, None] // levels)
        order = np.argsort(level, axis=0, kind="stable")
        self.segments = []
        for d in range(vectors.shape[1]):
            cuts = np.searchsorted(level[order[:, d], d], np.arange(1, levels))
            self.segments.append(np.split(order[:, d], cuts))

    def top(self, query: np.ndarray, k: int, own: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best vectors other than those of id `own`; all, if there are fewer."""
        weight = np.abs(query)
        up = (query > 0)[:, None]
        # What a vector has above the least value of its dimension, seen in the query's direction, at least and at most.
        least = np.where(up, self.floor[:, :-1] - self.low[:, None], self.high[:, None] - self.floor[:, 1:] + 1) * weight[:, None]
        most = np.where(up, self.floor[:, 1:] - 1 - self.low[:, None], self.high[:, None] - self.floor[:, :-1]) * weight[:, None]
        filled = np.array([[len(s) > 0 for s in row] for row in self.segments]) & (weight > 0)[:, None]
        d_of, l_of = np.nonzero(filled)
        order = np.argsort(-least[d_of, l_of], kind="stable")
        d_of, l_of = d_of[order], l_of[order]
        sums = np.zeros(len(self.ids), np.int64)
        others = self.ids != own
        if not others.any():
            return self.ids[:0], sums[:0]
        slack = np.where(filled, most - least, 0)
        alive = np.flatnonzero(others)
        for at in range(0, len(order), _STRIDE):
            for d, j in zip(d_of[at : at + _STRIDE].tolist(), l_of[at : at + _STRIDE].tolist(), strict=True):
                sums[self.segments[d][j]] += least[d, j]
            done = np.zeros(filled.shape, bool)
            done[d_of[: at + _STRIDE], l_of[: at + _STRIDE]] = True
            room = int(np.maximum(np.where(done, slack, 0).max(axis=1), np.where(filled & ~done, most, 0).max(axis=1)).sum())
            have = sums[others]
            bar = np.partition(have, len(have) - k)[len(have) - k] if len(have) > k else have.min()
            alive = np.flatnonzero(others & (sums + room >= bar))
            if len(alive) <= 8 * k:
                break
        scores = self.vectors[alive] @ query
        best = np.lexsort((self.ids[alive], -scores))[:k]
        return self.ids[alive[best]], scores[best]


def _finite(v: Column) -> Column:
    return F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def top_k(vectors: DataFrame, queries: Column, k: int = TOP, scale: int = SCALE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each row that `queries` picks, own vec_id excepted, ties to the
    smaller vec_id. vectors: vec_id, embedding.

    Components become floor(scale * x). Rows without a vec_id, and vectors that are null or hold null or non-finite
    components, take no part; vectors meet only others of their length. Rows that repeat a vec_id with the same vector
    count once as a query and each as a candidate; a query that repeats with another vector is asked for each. An
    empty table gives no rows. Scores are 64-bit integers.

    Vectors are dealt into blocks by a hash of their row, and every block is asked all queries, which stream past its index;
    from each block k rows a query go on to be merged.
    """
    whole = vectors.where(F.col("vec_id").isNotNull() & _finite(F.col("embedding")))
    rows = whole.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))
    blocks = max(1, -(-rows.count() // block_rows))
    lot = F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int")
    stored = rows.select(lot.alias("block"), F.size("v").alias("size"), F.lit(False).alias("asked"), "vec_id", "v")
    asked = rows.where(queries).distinct().select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.size("v").alias("size"), F.lit(True).alias("asked"), "vec_id", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, ids, parts, index = None, [], [], None
        for batch in batches:
            out: list[tuple] = []
            block, size, is_query, vec_id = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            offsets, values = batch.column(4).offsets.to_numpy(), batch.column(4).values.to_numpy()
            cuts = np.flatnonzero((np.diff(block) != 0) | (np.diff(size) != 0) | (np.diff(is_query.astype(np.int8)) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(block)], strict=True):
                if a == b:
                    continue
                found = values[offsets[a] : offsets[b]].reshape(b - a, int(size[a]))
                if group != (block[a], size[a]):
                    group, ids, parts, index = (block[a], size[a]), [], [], None
                if not is_query[a]:
                    ids.append(vec_id[a:b].copy())
                    parts.append(found.copy())
                    continue
                if index is None and parts:
                    index, parts = ImpactIndex(np.concatenate(ids), np.concatenate(parts)), []
                if index is not None:
                    for q, vector in zip(vec_id[a:b].tolist(), found, strict=True):
                        near, scores = index.top(vector, k, q)
                        out += [(q, vector.tobytes(), n, s) for n, s in zip(near.tolist(), scores.tolist(), strict=True)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.binary(), pa.int64(), pa.int64()), strict=True)], ["query_id", "query", "vec_id", "score"])

    dealt = stored.unionByName(asked).repartition(blocks, "block").sortWithinPartitions("block", "size", "asked")
    found = dealt.mapInArrow(run, "query_id long, query binary, vec_id long, score long")
    order = Window.partitionBy("query_id", "query").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: the rows whose vec_id is divisible by 100, against all rows."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)


ORACLE_SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % {EVERY} = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= {TOP}
"""
