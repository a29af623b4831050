"""Homomorphic multiset hash of a document's paragraphs.

A paragraph is a line of the text. It adds to a vector of 32-bit lanes, modulo 2^32: to the first DENSE lanes an
extendable-output hash of its bytes, and to the SKETCH lanes after them +1 or -1 for each of its word triples, in the
lane that the triple's hash names. Adding is commutative and can be undone, so a fingerprint doesn't depend on the
order of paragraphs, and paragraphs can be put in or taken out without the rest of the text. The dense lanes decide
equality; the cosine of the sketch lanes estimates how much two texts share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.llm.shared import doc_texts, slices, table

DENSE, SKETCH = 32, 256
MOST_RANGES = 100_000
RANGE_BYTES = 8 << 20
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def paragraph_vector(paragraphs: Iterable[str]) -> np.ndarray:
    """Sum of the vectors of the paragraphs; the empty one counts too."""
    raw = [p.encode() for p in paragraphs]
    out = np.zeros(DENSE + SKETCH, np.uint32)
    if not raw:
        return out
    digests = b"".join([hashlib.shake_128(p).digest(4 * DENSE) for p in raw])
    out[:DENSE] = np.frombuffer(digests, "<u4").reshape(-1, DENSE).sum(axis=0, dtype=np.uint32)
    words = [p.split() for p in raw]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    total = int(sizes.sum())
    if not total:
        return out
    hashes = np.fromiter((h for w in words for h in map(xxhash.xxh3_64_intdigest, w)), np.uint64, total)
    owner = np.repeat(np.arange(len(words)), sizes)
    # A paragraph of one or two words gives what it has; the places past its end count as zero.
    second = np.where(np.append(owner[1:], -1) == owner, np.append(hashes[1:], np.uint64(0)), np.uint64(0))
    third = np.where(np.append(owner[2:], [-1, -1])[:total] == owner, np.append(hashes[2:], np.zeros(2, np.uint64))[:total], np.uint64(0))
    first_of_paragraph = np.append(True, owner[1:] != owner[:-1])
    triple = hashes * _ODD[0] + second * _ODD[1] + third * _ODD[2]
    triple = triple[(third != 0) | first_of_paragraph]
    triple ^= triple >> np.uint64(29)
    triple *= _ODD[1]
    triple ^= triple >> np.uint64(32)
    lane = (triple % np.uint64(SKETCH)).astype(np.int64)
    sign = ((triple >> np.uint64(63)).astype(np.float64)) * 2 - 1
    out[DENSE:] = np.bincount(lane, sign, SKETCH).astype(np.int64).astype(np.uint32)
    return out


def text_vector(text: str) -> np.ndarray:
    return paragraph_vector(text.split("\n"))


def to_hex(vector: np.ndarray) -> str:
    return vector.astype(">u4").tobytes().hex()


def from_hex(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u4").astype(np.uint32)


def changed(fingerprint: str, added: Iterable[str] = (), removed: Iterable[str] = ()) -> str:
    """The fingerprint after paragraphs are put in and taken out."""
    return to_hex(from_hex(fingerprint) + paragraph_vector(added) - paragraph_vector(removed))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1; 1 for equal fingerprints. A lane holds up to 2^31 triples of one kind before it wraps."""
    if (a == b).all():
        return 1.0
    x, y = a[DENSE:].astype(np.int32).astype(np.float64), b[DENSE:].astype(np.int32).astype(np.float64)
    norm = float(np.sqrt((x @ x) * (y @ y)))
    return min(1.0, max(0.0, float(x @ y) / norm)) if norm else 0.0


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and the fingerprint of each text (null: empty), as a map without a shuffle. Repeated rows stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [to_hex(text_vector(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["doc_id", "fingerprint"])

    return doc_texts(docs).mapInArrow(run, "doc_id long, fingerprint string")


def with_following(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """part, edge, doc_id, text in an order in which every document is followed by the next one of ascending doc_id.

    Rows are dealt by ranges of doc_id (without one: first; ties by text); after the last row of a range stands, with
    edge true, a copy of the first row of the next range that has rows, of the first range after the last. Only the bounds
    of at most MOST_RANGES ranges reach the driver, and one row a range is moved besides the documents.
    """
    texts = doc_texts(docs)
    n, size = texts.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    ranges = int(max(1, min(MOST_RANGES, n, max(4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), (size or 0) // range_bytes))))
    shares = [i / ranges for i in range(1, ranges)] or [0.5]
    bounds = texts.agg(F.percentile_approx("doc_id", shares, F.lit(20 * ranges))).first()[0] or []
    bounds = np.unique(np.array(bounds, np.int64))

    @F.pandas_udf("int")
    def part_of(doc_id: pd.Series) -> pd.Series:
        known = doc_id.notna()
        return pd.Series(np.where(known, np.searchsorted(bounds, doc_id.where(known, 0).astype("int64"), side="right"), 0))

    rows = texts.select(part_of("doc_id").alias("part"), F.lit(False).alias("edge"), "doc_id", "text")
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).select(part_of("doc_id").alias("part"), F.col("doc_id").isNotNull().alias("known"), "doc_id")
    firsts = ids.groupBy("part").agg(F.min(F.struct("known", "doc_id")).alias("first")).select("part", "first.doc_id")
    window = Window.orderBy("part")
    previous = firsts.select(F.coalesce(F.lag("part").over(window), F.last("part").over(window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("part"), "doc_id")
    found = texts.join(F.broadcast(previous), texts.doc_id.eqNullSafe(previous.doc_id)).groupBy("part").agg(F.min(F.struct(texts.doc_id, "text")).alias("row"))
    edges = found.select("part", F.lit(True).alias("edge"), "row.doc_id", "row.text")
    return rows.unionByName(edges).repartition("part").sortWithinPartitions("part", "edge", "doc_id", "text")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text (null: empty) and of its edited text, and how alike the neighbours are.

    Edited: the last half of the code points (rounded down) replaced by as many from the start of the next document (all, if it
    has fewer), in ascending doc_id; after the last comes the first. An only document follows itself. Rows of one
    doc_id follow each other in the order of their texts; an empty table gives no rows.
    """
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in slices(batches, 3):
            out = []
            for part, edge, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                vector = text_vector(text)
                if held and held[0] == part:
                    _, name, old, own = held
                    half = len(old) // 2
                    edited = old[: len(old) - half] + text[:half]
                    other = text_vector(edited)
                    out.append((name, len(old), hashlib.sha256(edited.encode()).hexdigest(), to_hex(own), to_hex(other), likeness(own, other), likeness(own, vector)))
                held = None if edge else (part, doc_id, text, vector)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()), strict=True)], [x.split(" ")[0] for x in schema.split(", ")])

    return with_following(docs).mapInArrow(run, schema)


def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query over every document."""
    return edited_fingerprints(table(spark, sf_dir, "documents"))
