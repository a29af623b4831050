"""Evidence from map layers and register matches, ready for the roll-up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import vocab
from cairn.functions.text import ascii_slug, decomposed_ascii, slug
from cairn.operators import matching

EVIDENCE = ["poi_id", "source_id", "evidence_type", "label", "evidence_key", "confidence", "haystack", "property_category"]


def _layer(source: str) -> tuple:
    return next(x for x in vocab.LAYERS if x[0] == source)


def _rows(found: DataFrame, source: str, kind: str, confidence) -> DataFrame:
    key = F.substring(slug(F.concat_ws("-", F.lit(source), F.col("feature_id").cast("string"), F.col("poi_id").cast("string"))), 1, 255)
    return found.select("poi_id", F.lit(source).alias("source_id"), F.lit(kind).alias("evidence_type"), "label", key.alias("evidence_key"), F.round(confidence, 3).alias("confidence"), F.lower("label").alias("haystack"), F.lit(None).cast("string").alias("property_category"))


def from_points(features: DataFrame, places: DataFrame, source: str, metres: float = 250.0) -> DataFrame:
    """Evidence of a point layer: each feature (feature_id, label, lon, lat) goes to its best place (poi_id,
    canonical_name, category, lon, lat)."""
    pairs = matching.within_distance(features, places, metres)
    best = matching.best_place(pairs, matching.name_likeness(F.col("label"), F.col("canonical_name")), metres)
    return _rows(best, source, _layer(source)[2], F.col("confidence"))


def from_polygons(polygons: DataFrame, places: DataFrame, source: str, cell: float = 0.01) -> DataFrame:
    """Evidence of a polygon layer: each place (poi_id, x, y) in a polygon (feature_id, label, ring, holes), edges
    included; once for a feature, whatever number of its parts hold the place."""
    inside = matching.contained(places, polygons, cell).select("feature_id", "label", "poi_id").distinct()
    return _rows(inside, source, _layer(source)[2], F.lit(_layer(source)[6]))


def seeds(spark: SparkSession) -> DataFrame:
    """The seed aliases as rows: canonical_name, alias_name, normalized_alias, kind, confidence."""
    rows = [(name, alias, kind, c) for name, aliases in vocab.SEED_ALIASES.items() for alias, kind, c in aliases]
    df = spark.createDataFrame(rows, "canonical_name string, alias_name string, kind string, confidence double")
    return df.withColumn("normalized_alias", ascii_slug(decomposed_ascii(F.col("alias_name"))))
