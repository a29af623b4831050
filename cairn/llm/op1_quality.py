"""Quality classifier: histogram gradient-boosted trees over statistics of the whole text.

The trees are complete and stand level by level in arrays, so a batch of documents walks all trees at once with one
numpy gather for each level.
"""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.shared import doc_texts, slices, table

#: Labelled rows that a fit takes at most: those with the smallest hash of their doc_id.
FIT_ROWS = 20_000
KEEP_FROM = 0.3
_GROUPS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " ", "\n\r", ".", ",;:", "!?", "|", "#$%&*@^~", "\"'`()[]{}<>", "_-+=/\\", "\t\x00\x0b\x0c")
_CLASSES = np.zeros((256, len(_GROUPS) + 1))
for _i, _group in enumerate(_GROUPS):
    _CLASSES[[ord(c) for c in _group], _i] = 1
_CLASSES[128:, -1] = 1
N_FEATURES = len(_GROUPS) + 1 + 17


def features(text: str) -> list[float]:
    """Statistics of a whole text; those of an empty one are all zero."""
    raw = text.encode()
    n = len(raw)
    if not n:
        return [0.0] * N_FEATURES
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    shares = (counts @ _CLASSES / n).tolist()
    p = counts[counts > 0] / n
    words = raw.split()
    nw = len(words) or 1
    by_word = Counter(words)
    lines = raw.split(b"\n")
    filled = [x for x in lines if x]
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    pairs = len(set(zip(words, words[1:], strict=False)))
    top = sorted(by_word.values())[-3:] if words else [0]
    return shares + [
        float(n),
        float(len(words)),
        float(lengths.mean()),
        float(lengths.std()),
        float(lengths.max()),
        float((lengths <= 3).mean()),
        len(by_word) / nw,
        pairs / max(1, nw - 1),
        sum(map(operator.eq, words, words[1:])) / nw,
        top[-1] / nw,
        sum(top) / nw,
        float(-(p * np.log2(p)).sum()),
        float(len(filled)),
        len(set(filled)) / max(1, len(filled)),
        n / max(1, len(filled)),
        sum(w[-1:] in (b".", b",", b"!", b"?") for w in words) / nw,
        len({w.lower() for w in by_word}) / max(1, len(by_word)),
    ]


@dataclass
class Trees:
    """Complete trees of one depth: feature and threshold of inner nodes, values of leaves; [tree, place]."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        n, trees = len(x), len(self.feature)
        place = np.zeros((n, trees), np.int64)
        rows, columns = np.arange(n)[:, None], np.arange(trees)[None, :]
        for _ in range((self.leaf.shape[1] - 1).bit_length()):
            place = 2 * place + 1 + (x[rows, self.feature[columns, place]] > self.threshold[columns, place])
        return self.base + self.leaf[columns, place - self.feature.shape[1]].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 1.0, least: float = 1.0) -> Trees:
    """Boosting on the logistic loss; each level picks its splits from histograms of gradients over quantile bins."""
    inner, leaves = 2**depth - 1, 2**depth
    share = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    feature, threshold = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf)
    leaf = np.zeros((trees, leaves))
    if not len(y) or y.min() == y.max():
        return Trees(base, feature, threshold, leaf)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)])
    raw = np.full(len(y), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        place = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            at = place - first
            best = np.zeros(width)
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                key = at * (len(e) + 1) + binned[j]
                shape = (width, len(e) + 1)
                gl = np.bincount(key, g, width * shape[1]).reshape(shape).cumsum(axis=1)
                hl = np.bincount(key, h, width * shape[1]).reshape(shape).cumsum(axis=1)
                gs, hs = gl[:, -1:], hl[:, -1:]
                gl, hl = gl[:, :-1], hl[:, :-1]
                gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
                gain[(hl < least) | (hs - hl < least)] = 0
                k = gain.argmax(axis=1)
                better = gain[np.arange(width), k] > best + 1e-12
                best = np.where(better, gain[np.arange(width), k], best)
                feature[t, first : first + width][better] = j
                threshold[t, first : first + width][better] = e[k[better]]
            place = 2 * place + 1 + (x[np.arange(len(y)), feature[t, place]] > threshold[t, place])
        at = place - inner
        leaf[t] = -rate * np.bincount(at, g, leaves) / (np.bincount(at, h, leaves) + ridge)
        raw += leaf[t, at]
    return Trees(base, feature, threshold, leaf)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = FIT_ROWS) -> Trees:
    """Trees fitted on at most `most` labelled rows, those with the smallest hash of doc_id; their statistics are
    computed where the documents are, and only these come to the driver. Rows without a label or doc_id are left
    out; a document that occurs or is labelled more than once counts as often, within `most` rows in all. Without labels of both kinds every
    document scores the share of label 1 (a half without any)."""
    spark = docs.sparkSession
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("label")).where("doc_id is not null and label is not null")
    chosen = spark.createDataFrame(chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(most).collect(), chosen.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [features(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "label", "features"])

    found = doc_texts(docs).join(F.broadcast(chosen), "doc_id").mapInArrow(run, "doc_id long, label double, features array<double>")
    found = found.orderBy(F.xxhash64("doc_id"), "doc_id", "label", "features").limit(most)
    rows = sorted((r.doc_id, r.label, r.features) for r in found.collect())
    return fit_trees(np.array([r[2] for r in rows]).reshape(-1, N_FEATURES), np.array([r[1] for r in rows]))


def scored(docs: DataFrame, trees: Trees) -> DataFrame:
    """doc_id and score (0 to 1) of every document, empty ones too. A map: repeated rows stay, null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = np.array([features(t) for t in batch.column(1).to_pylist()]).reshape(-1, N_FEATURES)
            score = np.concatenate([trees.score(x[i : i + 4096]) for i in range(0, len(x), 4096)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], ["doc_id", "score"])

    return doc_texts(docs).mapInArrow(run, "doc_id long, score double")


def kept(docs: DataFrame, trees: Trees, from_score: float = KEEP_FROM) -> DataFrame:
    """The rows of docs that score from_score or more, with all their columns as they are."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            x = np.array([features(t or "") for t in batch.column(at).to_pylist()]).reshape(-1, N_FEATURES)
            yield batch.filter(pa.array(trees.score(x) >= from_score))

    return docs.mapInArrow(run, docs.schema)


def held_out(column: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def quality_model(docs: DataFrame, labels: DataFrame) -> Trees:
    """The model that the contract asks for: no label of a held-out row is seen."""
    return fit(docs, labels.where(~held_out()))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: the score of every document; the smoothing of the leaves keeps it between 0 and 1."""
    docs = table(spark, sf_dir, "documents")
    trees = quality_model(docs, table(spark, sf_dir, "labels"))
    return scored(docs, trees).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= KEEP_FROM).cast("int").alias("predicted"))
