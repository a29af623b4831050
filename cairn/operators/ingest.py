"""Ingest runs: a fetched batch goes into versioned snapshots, then the places of a region are worked out again from its current records.

A run is one commit of a store: snapshots, audit, places, signals, editorial stubs and theme memberships change together or not at all. Its counters are taken while the tables are written.
"""

from __future__ import annotations

import logging
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators import classify, runs
from cairn.operators.editorial import stubs
from cairn.operators.snapshots import KEY
from cairn.sources.metrics import Counters, log_event

_LOG = logging.getLogger(__name__)
#: What a place takes from its audited record, by the place's column.
FIELDS = {
    "canonical_name": "canonical_name", "slug": "slug", "lon": "lon", "lat": "lat", "normalized_category": "category", "normalized_subcategory": "kind", "display": "display",
    "short_description": "short_description", "tags": "tags", "tag_summary": "tag_summary", "base_significance": "base_significance", "quality_score": "quality_score",
    "walk_affinity": "walk_affinity", "drive_affinity": "drive_affinity",
}
_POINT = "struct<lat:double,lon:double>"
_ELEMENT = f"type string, id bigint, lat double, lon double, tags map<string,string>, center {_POINT}, geometry array<{_POINT}>, bounds struct<minlat:double,minlon:double,maxlat:double,maxlon:double>"
#: The tables of a store before its first run.
TABLES = {
    "raw": f"source_name string, record_id string, content_hash string, fetched_at timestamp, run_id string, {_ELEMENT}, is_current boolean",
    "runs": "run_id string, source_name string, region string, started_at timestamp",
    "poi": "poi_id bigint, record_id string, city string, canonical_name string, slug string, lon double, lat double, normalized_category string, normalized_subcategory string, display array<string>, short_description string, tags map<string,string>, tag_summary map<string,string>, base_significance double, quality_score double, walk_affinity double, drive_affinity double, review_status string, is_active boolean",
    "signals": "poi_id bigint, source_count bigint, entity_type_confidence double, has_wikidata boolean, has_wikipedia boolean, tag_richness double, description_quality double, local_identity double, interpretive_value double, genericity double, editorial_seed double, official double, district double, institutional double, heritage boolean",
    "editorial": "poi_id bigint, editorial_status string, boost int, title string",
    "evidence": "evidence_id bigint, poi_id bigint, haystack string",
    "memberships": "poi_id bigint, theme string, status string, basis string, confidence double, rationale string, evidence_ids array<bigint>, computed_at timestamp",
}


def hashed(elements: DataFrame, source: str, fetched_at: Column, run_id: str) -> DataFrame:
    """A batch of raw elements (see TABLES) as snapshots of a source, one a record: of repeated records the one with the largest hash. The hash covers all of an element, its tags in order of their keys."""
    rest = F.to_json(F.struct("type", "id", "lat", "lon", "center", "geometry", "bounds", F.array_sort(F.map_entries("tags")).alias("tags")))
    names = [c.split(" ")[0] for c in ("type", "id", "lat", "lon", "tags", "center", "geometry", "bounds")]
    rows = elements.select(F.lit(source).alias("source_name"), F.concat_ws("/", "type", F.col("id").cast("string")).alias("record_id"), F.sha2(rest.cast("binary"), 256).alias("content_hash"), *names)
    one = rows.groupBy(*KEY).agg(F.max_by(F.struct("content_hash", *names), "content_hash").alias("row"))
    return one.select(*KEY, "row.content_hash", fetched_at.alias("fetched_at"), F.lit(run_id).alias("run_id"), *(f"row.{n}" for n in names))


def as_of(snapshots: DataFrame, at: Column | None = None) -> DataFrame:
    """The last snapshot of each record by fetched_at and seq, of those fetched until `at`. All columns; partial maxima move, not a record's rows."""
    rows = snapshots if at is None else snapshots.where(F.col("fetched_at") <= at)
    rest = [c for c in snapshots.columns if c not in KEY]
    return rows.groupBy(*KEY).agg(F.max_by(F.struct(*rest), F.struct("fetched_at", "seq")).alias("last")).select(*KEY, "last.*")


def latest_tags(snapshots: DataFrame) -> DataFrame:
    """poi_id, tags without nulls: of each place's current snapshots the one fetched last, of several the one with the largest record_id. Places without any have no row; null tags are none."""
    live = snapshots.where(F.col("is_current") & F.col("poi_id").isNotNull())
    last = live.groupBy("poi_id").agg(F.max_by("tags", F.struct("fetched_at", "record_id")).alias("tags"))
    empty = F.create_map().cast("map<string,string>")
    return last.select("poi_id", F.coalesce(F.map_filter("tags", lambda k, v: v.isNotNull()), empty).alias("tags"))


def merged_raw(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """stored snapshots (KEY, content_hash, is_current and any others) after a batch of the same columns but is_current, one row a record. action: new; touched (same content: the batch's row takes the
    stored one's place); closed and changed (other content: one row each); absent (not in the batch: stays current); history (closed before)."""
    columns = [c for c in stored.columns if c not in (*KEY, "is_current")]
    old = stored.where("is_current").select(*KEY, F.struct(*columns).alias("old"))
    both = old.join(batch.select(*KEY, F.struct(*columns).alias("new")), KEY, "full")
    row = lambda side, live, action: F.struct(F.col(side).alias("row"), F.lit(live).alias("is_current"), F.lit(action).alias("action"))
    same = F.col("old.content_hash").eqNullSafe(F.col("new.content_hash"))
    rows = F.when(F.col("new").isNull(), F.array(row("old", True, "absent"))).when(F.col("old").isNull(), F.array(row("new", True, "new"))).when(same, F.array(row("new", True, "touched"))).otherwise(F.array(row("old", False, "closed"), row("new", True, "changed")))
    found = both.select(*KEY, F.inline(rows)).select(*KEY, "row.*", "is_current", "action")
    return found.unionByName(stored.where(~F.coalesce("is_current", F.lit(False))).withColumn("action", F.lit("history")))


def of_region(current: DataFrame, ran: DataFrame, source: str, region: str) -> DataFrame:
    """Current snapshots of a source whose run was one of the region. ran: run_id, region."""
    return current.where(F.col("source_name") == source).join(ran.where(F.col("region") == region).select("run_id"), "run_id", "left_semi")


def refreshed(places: DataFrame, audit: DataFrame, city: str) -> DataFrame:
    """places (poi_id, record_id, city, those of FIELDS that they have, review_status, is_active and any others) after the classified rows of an audit, with action: inserted,
    updated or kept. Whatever doesn't come from a record stays. A new place needs review, is active, and is named by a 64-bit hash of its record: a commit checks that no two share one."""
    fields = {k: v for k, v in FIELDS.items() if k in places.columns}
    new = audit.where("status = 'classified'").select("record_id", F.struct(*(F.col(v).alias(k) for k, v in fields.items()), F.lit(city).alias("city")).alias("new"))
    both = places.withColumn("stored", F.lit(True)).join(new, "record_id", "full")
    met, fresh = F.col("new").isNotNull(), F.col("stored").isNull()
    made = {"poi_id": F.xxhash64("record_id"), "review_status": F.lit("needs_review"), "is_active": F.lit(True)}
    pick = lambda c: F.when(met, F.col(f"new.{c}")).otherwise(F.col(c)) if c in fields or c == "city" else F.when(fresh, made[c]).otherwise(F.col(c)) if c in made else F.col(c)
    action = F.when(~met, "kept").when(fresh, "inserted").otherwise("updated")
    return both.select(*(pick(c).alias(c) for c in places.columns), action.alias("action"))


def reset_signals(audit: DataFrame, places: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Signals of the places that an audit's classified rows give, as ingested: nothing official yet. source_count: all snapshots of the record, closed ones too."""
    rows = audit.where("status = 'classified'")
    counts = snapshots.groupBy("record_id").agg(F.count(F.lit(1)).alias("source_count"))
    found = classify.first_signals(rows).join(places.select("record_id", "poi_id"), "record_id").join(counts, "record_id", "left")
    return found.withColumns({"source_count": F.greatest(F.coalesce("source_count", F.lit(0)), F.lit(1)).cast("bigint"), "entity_type_confidence": F.lit(0.75), "heritage": F.lit(False)})


def run(store: runs.Store, source: str, region: str, now: Column, elements: DataFrame | None = None) -> dict:
    """An ingest run of raw elements, or without them a refresh of the region from what is stored. Returns its version and counters: raw_inserted, raw_updated, canonical_inserted,
    canonical_updated, skipped. Fails with runs.Conflict if another run came first; then, and on any other error, the run log says failed and the last version stays."""
    spark: SparkSession = store.spark
    kind = "refresh" if elements is None else "ingest"
    run_id, base, counters = f"{kind}-{uuid.uuid4().hex}", store.version(), Counters()
    store.log(run_id, "running", source=source, region=region)
    log_event(_LOG, f"{kind}_started", region=region, run=run_id)
    try:
        t = {name: spark.createDataFrame([], schema) for name, schema in TABLES.items()} | store.read(base)
        new: dict[str, DataFrame | str] = {}
        ran, raw = t["runs"], t["raw"]
        if elements is not None:
            ran = ran.unionByName(spark.range(1).select(F.lit(run_id).alias("run_id"), F.lit(source).alias("source_name"), F.lit(region).alias("region"), now.alias("started_at")))
            merged = merged_raw(raw, hashed(elements, source, now, run_id))
            merged = counters.on(merged, raw_inserted=F.col("action").isin("new", "changed"), raw_updated=F.col("action") == "touched")
            new |= {"runs": ran, "raw": store.stage("raw", merged.select(*t["raw"].columns))}
            raw = store.at(new["raw"])
        audit = classify.audited(of_region(raw.where("is_current"), ran, source, region)).select("record_id", "status", *FIELDS.values())
        new["audit"] = store.stage("audit", counters.on(audit, skipped=F.col("status") != "classified"))
        audit = store.at(new["audit"])
        places = counters.on(refreshed(t["poi"], audit, region), canonical_inserted=F.col("action") == "inserted", canonical_updated=F.col("action") == "updated")
        new["poi"] = store.stage("poi", places.drop("action"))
        places = store.at(new["poi"])
        touched = audit.where("status = 'classified'").join(places.select("record_id", "poi_id"), "record_id").select("poi_id")
        signals = reset_signals(audit, places, raw).select(*t["signals"].columns)
        new["signals"] = t["signals"].join(touched, "poi_id", "left_anti").unionByName(signals)
        blank = stubs(places, t["editorial"]).select("poi_id", F.lit("draft").alias("editorial_status"), F.lit(0).alias("boost"), F.lit(None).cast("string").alias("title"))
        new["editorial"] = t["editorial"].unionByName(blank)
        aliased = places.withColumn("aliases", F.array().cast("array<string>"))
        new["memberships"] = runs.memberships_after(t["memberships"], aliased, t["evidence"], touched, now)
        of_poi = [(name, ["poi_id"], "poi", ["poi_id"]) for name in ("signals", "editorial", "memberships")]
        rules = of_poi + ([("raw", ["run_id"], "runs", ["run_id"])] if elements is not None else [])
        keys = {"poi": ["poi_id"], "signals": ["poi_id"], "editorial": ["poi_id"], "memberships": ["poi_id", "theme"], "runs": ["run_id"]}
        version = store.commit(new, base, keys=keys, parents=rules)
    except Exception as error:
        store.log(run_id, "failed", reason=str(error)[:500])
        raise
    found = counters.values()
    store.log(run_id, "completed", version=version, **found)
    log_event(_LOG, f"{kind}_completed", region=region, run=run_id, **found)
    return {"version": version, "run": run_id} | found
