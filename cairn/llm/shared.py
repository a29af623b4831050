"""What the operators of this subpackage share: the shared folder, written tables, row-wise text access."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZER_FILE = "byte_bpe_50k.json"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or our own where it is unset and Spark is one local process (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.match(r"local(\[.*\])?$", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (named or "file:///tmp/checkpoints/cairn").rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a written table in the shared folder: its lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that written() made and that nothing lazy reads any more."""
    for df in tables:
        spark = df.sparkSession
        for file in df.inputFiles()[:1]:
            path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def doc_texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text (null: empty) and the columns named; any other columns, however named, go."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), *(F.col(c) for c in more))


def slices(batches: Iterator[pa.RecordBatch], column: int = 1, most_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about most_bytes of the given text column, so that long texts don't pile up."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        step = max(1, min(batch.num_rows, int(batch.num_rows * most_bytes / max(1, batch.column(column).nbytes))))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
