"""From raw documents to token ids: quality, near duplicates, personal data, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before kept, and returns a DataFrame; all but
the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cairn.llm import op1_quality, op3_mixing, op4_bpe, op8_near_duplicates, op9_pii
from cairn.llm.shared import TOKENIZER_FILE, new_path, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It is fitted on the labelled rows of docs that aren't held out."""
    return op1_quality.kept(docs, op1_quality.quality_model(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the smallest doc_id."""
    return op8_near_duplicates.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each span of personal data is replaced by its kind in brackets; no document goes."""
    return op9_pii.redacted(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated until the languages' expected tokens meet their target shares; none goes."""
    return op3_mixing.mixed(docs, table(spark, sf_dir, "labels"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and the decoded text's SHA-256, of every row."""
    return op4_bpe.encode_decode(docs, public_tokenizers.path(TOKENIZER_FILE), ("n_tokens", "ids", "decoded_sha256"), slice_bytes=1 << 20)


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixing", mixing),
    ("token_ids", token_ids),
]

#: SQL can express neither the fitted models nor the encoding: the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
