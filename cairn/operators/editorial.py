"""Keyed merges of editorial work: upserts, aliases, diagnostics, cascading resets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.text import ascii_slug


def upserted(stored: DataFrame, changes: DataFrame, key: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """stored with changes by key: non-null values of changes win, except in the columns of keep, where stored ones do.
    action: inserted, updated or kept."""
    columns = [c for c in stored.columns if c != key]
    s = stored.select(key, *(F.col(c).alias(f"s_{c}") for c in columns), F.lit(True).alias("in_s"))
    n = changes.select(key, *(F.col(c).alias(f"n_{c}") for c in columns if c in changes.columns), F.lit(True).alias("in_n"))
    pick = lambda c: F.col(f"s_{c}") if c not in changes.columns else F.coalesce(f"s_{c}", f"n_{c}") if c in keep else F.coalesce(f"n_{c}", f"s_{c}")
    action = F.when(F.col("in_s").isNull(), "inserted").when(F.col("in_n").isNull(), "kept").otherwise("updated")
    return s.join(n, key, "full").select(key, *(pick(c).alias(c) for c in columns), action.alias("action"))


def stubs(places: DataFrame, editorial: DataFrame) -> DataFrame:
    """Keys of places that have no editorial row yet."""
    return places.select("poi_id").join(editorial.select("poi_id"), "poi_id", "left_anti")


def new_aliases(seeds: DataFrame, places: DataFrame, aliases: DataFrame) -> DataFrame:
    """Seeds (canonical_name, alias_name, normalized_alias) for the places of that name that lack the alias; of places
    with one name the one with the largest poi_id."""
    named = places.groupBy("canonical_name").agg(F.max("poi_id").alias("poi_id"))
    return seeds.join(named, "canonical_name").join(aliases.select("poi_id", "normalized_alias"), ["poi_id", "normalized_alias"], "left_anti")


def alias_conflicts(wanted: DataFrame, aliases: DataFrame) -> DataFrame:
    """wanted (poi_id, normalized_alias) that another place owns."""
    owners = aliases.select(F.col("poi_id").alias("owner"), "normalized_alias")
    return wanted.join(owners, "normalized_alias").where("owner <> poi_id").select("poi_id", "normalized_alias", "owner")


def first_conflicts(wanted: DataFrame, aliases: DataFrame) -> DataFrame:
    """wanted (poi_id, normalized_alias) that other places own: the smallest poi_id among these, and how many they are. Owners
    are added up by alias before the join, so a name that many places have makes no pairs."""
    owners = aliases.select("normalized_alias", "poi_id").distinct()
    low = owners.groupBy("normalized_alias").agg(F.min("poi_id").alias("low"), F.count(F.lit(1)).alias("n"))
    second = owners.join(low, "normalized_alias").where("poi_id > low").groupBy("normalized_alias").agg(F.min("poi_id").alias("second"))
    held = low.join(second, "normalized_alias", "left")
    own = owners.withColumn("own", F.lit(1))
    rows = wanted.join(held, "normalized_alias").join(own, ["normalized_alias", "poi_id"], "left")
    owner = F.when(F.col("poi_id") == F.col("low"), F.col("second")).otherwise(F.col("low"))
    rows = rows.select("poi_id", "normalized_alias", owner.alias("owner"), (F.col("n") - F.coalesce("own", F.lit(0))).alias("others"))
    return rows.where("others > 0")


def without_region(tables: dict[str, DataFrame], city: str) -> dict[str, DataFrame]:
    """All tables after the places of a city go, with every row of every table that has their poi_id."""
    gone = tables["poi"].where(F.col("city") == city).select("poi_id")
    return {name: t.join(gone, "poi_id", "left_anti") for name, t in tables.items()}


def pending(status: str, shown: Column) -> Column:
    """Which diagnostics a queue shows: all, or one status, under which unmatched ones count as unreviewed."""
    if status == "all":
        return F.lit(True)
    return shown.isin("unreviewed", "unmatched") if status == "unreviewed" else shown == status


def reviewed_diagnostics(diagnostics: DataFrame, reviews: DataFrame) -> DataFrame:
    """diagnostics (id, status, resolved_poi) after reviews (id, new_status, new_poi): outcome is applied, refused or
    untouched. A diagnostic that has been reviewed takes only the same review again."""
    rows = diagnostics.join(reviews, "id", "left")
    same = (F.col("status") == F.col("new_status")) & F.col("resolved_poi").eqNullSafe(F.col("new_poi"))
    may = F.col("status").isin("unreviewed", "unmatched") | same
    outcome = F.when(F.col("new_status").isNull(), "untouched").when(may, "applied").otherwise("refused")
    taken = outcome == "applied"
    return rows.select("id", outcome.alias("outcome"), F.when(taken, F.col("new_status")).otherwise(F.col("status")).alias("status"), F.when(taken, F.col("new_poi")).otherwise(F.col("resolved_poi")).alias("resolved_poi"))


def reviewed_themes(decisions: DataFrame, memberships: DataFrame) -> DataFrame:
    """decisions (poi_id, theme, decision) with the stamp of the membership that was seen; accepted is false where there
    is none, unless the decision brings the theme in."""
    rows = decisions.join(memberships.select("poi_id", "theme", F.col("computed_at").alias("stamp"), F.lit(True).alias("member")), ["poi_id", "theme"], "left")
    accepted = F.coalesce("member", F.lit(False)) | (F.col("decision") == "force_include")
    return rows.select("poi_id", "theme", "decision", "stamp", accepted.alias("accepted"))


def official_evidence(diagnostics: DataFrame) -> DataFrame:
    """Evidence of full confidence for diagnostics that were resolved to a place; one row an evidence_key, of a longer key
    the first 255 characters. diagnostics: resolved_poi, status, source_id, register_name, reference_number."""
    key = F.substring(ascii_slug(F.concat_ws("-", "source_id", F.coalesce("reference_number", F.lit("")), "register_name")), 1, 255)
    rows = diagnostics.where("status = 'resolved' AND resolved_poi IS NOT NULL").withColumn("evidence_key", key)
    return rows.groupBy("evidence_key").agg(F.max("resolved_poi").alias("poi_id")).select("poi_id", "evidence_key", F.lit("historic_designation").alias("evidence_type"), F.lit(1.0).alias("confidence"))
