"""The snapshot merge for a stream of fetched batches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cairn.operators.snapshots import KEY, merged


def merge_stream(spark: SparkSession, stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Merges each micro-batch (KEY, content_hash, fetched_at) into versions under folder. A version is a new path, named in the
    pointer table that is read for the next one, so a batch that is run again leaves one state."""
    def step(batch: DataFrame, number: int) -> None:
        pointers = spark.read.schema("number long, path string").parquet(f"{folder}/pointers") if number else None
        before = pointers.where(F.col("number") < number).orderBy(F.col("number").desc()).first() if pointers is not None else None
        schema = "source_name string, record_id string, content_hash string, fetched_at timestamp, is_current boolean"
        stored = spark.read.schema(schema).parquet(before.path) if before else spark.createDataFrame([], schema)
        latest = batch.groupBy(*KEY).agg(F.max(F.struct("fetched_at", "content_hash")).alias("last")).select(*KEY, "last.fetched_at", "last.content_hash")
        path = f"{folder}/versions/{number}-{uuid.uuid4().hex}"
        merged(stored, latest).drop("action").write.parquet(path)
        spark.createDataFrame([(number, path)], "number long, path string").write.mode("append").parquet(f"{folder}/pointers")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
