"""Versioned raw snapshots: change points of content by record, and merging a fetched batch into what is stored."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["source_name", "record_id"]


def versions(snapshots: DataFrame) -> DataFrame:
    """Rows at which a record's content changed, with version and is_current. snapshots: source_name, record_id,
    fetched_at, seq (breaks ties of time), content_hash. One shuffle by record serves all windows."""
    by = Window.partitionBy(*KEY).orderBy("fetched_at", "seq")
    changed = snapshots.withColumn("before", F.lag("content_hash").over(by)).where(F.col("before").isNull() | (F.col("before") != F.col("content_hash"))).drop("before")
    return changed.withColumns({"version": F.row_number().over(by), "is_current": F.lead("seq").over(by).isNull()})


def current(snapshots: DataFrame) -> DataFrame:
    """The latest change of each record: the earliest row with the latest content after the last row with another. Maxima and minima by record, taken before
    rows move; no window over a record's rows."""
    at = F.struct("fetched_at", "seq")
    last = snapshots.groupBy(*KEY).agg(F.max_by("content_hash", at).alias("latest"))
    rows = snapshots.join(last, KEY)
    other = rows.groupBy(*KEY).agg(F.max(F.when(F.col("content_hash") != F.col("latest"), at)).alias("other"))
    after = rows.where("content_hash = latest").join(other, KEY).where(F.col("other").isNull() | (at > F.col("other")))
    return after.groupBy(*KEY).agg(F.min(F.struct("fetched_at", "seq", "content_hash")).alias("first")).select(*KEY, "first.*")


def merged(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """stored (KEY, content_hash, fetched_at, is_current) after a batch (KEY, content_hash, fetched_at; one row a key):
    same content touches the row, other content closes it and opens a new one, absent records stay. action tells which."""
    now = stored.where("is_current").select(*KEY, F.col("content_hash").alias("old_hash"), F.col("fetched_at").alias("old_at"))
    both = now.join(batch.select(*KEY, "content_hash", "fetched_at"), KEY, "full")
    same = F.coalesce(F.col("old_hash") == F.col("content_hash"), F.lit(False))
    row = lambda hash_, at, live, action: F.struct(F.col(hash_).alias("content_hash"), F.col(at).alias("fetched_at"), F.lit(live).alias("is_current"), F.lit(action).alias("action"))
    rows = F.when(F.col("content_hash").isNull(), F.array(row("old_hash", "old_at", True, "absent"))).when(F.col("old_hash").isNull(), F.array(row("content_hash", "fetched_at", True, "new"))).when(same, F.array(row("content_hash", "fetched_at", True, "touched"))).otherwise(F.array(row("old_hash", "old_at", False, "closed"), row("content_hash", "fetched_at", True, "changed")))
    history = stored.where(~F.col("is_current")).select(*KEY, "content_hash", "fetched_at", "is_current", F.lit("history").alias("action"))
    return both.select(*KEY, F.inline(rows)).unionByName(history)
