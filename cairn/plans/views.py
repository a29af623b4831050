"""Place tables derived from the star schema, in SQL that both engines read: whole-number arithmetic, plain doubles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import geo
from cairn.operators.evidence import rollup

POI = """
SELECT p_partkey AS poi_id, city, is_active, canonical_name, lon, lat, category, secondary, base_significance, quality_score,
  walk_affinity, drive_affinity, tag_historic, tag_railway, tag_waterway, tag_tourism, tag_natural, tag_man_made,
  CASE category
    WHEN 'history' THEN CASE p_size % 4 WHEN 0 THEN 'historic_site' WHEN 1 THEN 'historic_district' WHEN 2 THEN 'museum' ELSE 'monument_memorial' END
    WHEN 'culture' THEN CASE p_size % 3 WHEN 0 THEN 'performance_cultural_venue' WHEN 1 THEN 'neighborhood_corridor' ELSE 'ritual_religious_site' END
    WHEN 'art' THEN CASE p_size % 2 WHEN 0 THEN 'mural_public_art' ELSE 'gallery_art_space' END
    WHEN 'scenic' THEN CASE p_size % 3 WHEN 0 THEN 'overlook_vista' WHEN 1 THEN 'trail_river_access' ELSE 'landscape_feature' END
    WHEN 'food' THEN 'market_food_identity'
    ELSE CASE p_size % 2 WHEN 0 THEN 'civic_space_plaza' ELSE 'infrastructure_landmark' END END AS subcategory
FROM (SELECT p_partkey, p_size,
  concat('region', CAST(p_partkey % 5 AS STRING)) AS city, p_partkey % 23 <> 0 AS is_active,
  concat(p_name, CASE p_partkey % 9 WHEN 0 THEN ' Depot' WHEN 1 THEN ' Gallery' WHEN 2 THEN ' Acequia' WHEN 3 THEN ' Trail'
    WHEN 4 THEN ' Plaza' WHEN 5 THEN ' Railyard' WHEN 6 THEN ' Bridge' ELSE '' END) AS canonical_name,
  CAST(-106.083 AS DOUBLE) + CAST((p_partkey * 7919) % 229000 AS DOUBLE) / CAST(1000000 AS DOUBLE) AS lon,
  CAST(35.612 AS DOUBLE) + CAST((p_partkey * 104729) % 132000 AS DOUBLE) / CAST(1000000 AS DOUBLE) AS lat,
  CASE p_type WHEN 'ECONOMY' THEN 'history' WHEN 'LARGE' THEN 'culture' WHEN 'MEDIUM' THEN 'art' WHEN 'PROMO' THEN 'scenic'
    WHEN 'SMALL' THEN 'food' ELSE 'civic' END AS category,
  CASE p_partkey % 7 WHEN 0 THEN 'history' WHEN 1 THEN 'culture' WHEN 2 THEN 'art' WHEN 3 THEN 'scenic' WHEN 4 THEN 'food'
    WHEN 5 THEN 'civic' ELSE NULL END AS secondary,
  CAST(40 + p_size AS DOUBLE) AS base_significance, CAST(30 + p_partkey % 66 AS DOUBLE) AS quality_score,
  CAST(50 + p_partkey % 50 AS DOUBLE) / CAST(100 AS DOUBLE) AS walk_affinity,
  CAST(50 + p_partkey % 45 AS DOUBLE) / CAST(100 AS DOUBLE) AS drive_affinity,
  CASE p_partkey % 11 WHEN 0 THEN 'railway_station' WHEN 1 THEN 'yes' WHEN 2 THEN 'church' ELSE NULL END AS tag_historic,
  CASE p_partkey % 13 WHEN 0 THEN 'station' WHEN 1 THEN 'rail' ELSE NULL END AS tag_railway,
  CASE WHEN p_partkey % 17 = 0 THEN 'river' ELSE NULL END AS tag_waterway,
  CASE WHEN p_partkey % 19 = 0 THEN 'viewpoint' WHEN p_partkey % 19 = 1 THEN 'museum' ELSE NULL END AS tag_tourism,
  CASE WHEN p_partkey % 8 = 0 THEN 'peak' ELSE NULL END AS tag_natural,
  CASE WHEN p_partkey % 29 = 0 THEN 'canal' ELSE NULL END AS tag_man_made
  FROM part) AS p
"""
EVIDENCE = """
SELECT l_orderkey * 10 + l_linenumber AS evidence_id, l_partkey AS poi_id,
  CASE (l_orderkey * 7 + l_linenumber) % 60 WHEN 0 THEN 'historic_building_status' WHEN 1 THEN 'district_membership' WHEN 2 THEN 'boundary_membership'
    WHEN 3 THEN 'institution_membership' WHEN 4 THEN 'historic_designation' WHEN 5 THEN 'state_historic_designation' ELSE 'survey_note' END AS evidence_type,
  CASE WHEN l_returnflag = 'R' THEN 'District' ELSE 'Building' END AS property_category,
  CASE l_suppkey % 7 WHEN 0 THEN 'Acequia Madre' WHEN 1 THEN 'Railyard boundary' WHEN 2 THEN 'River Trail' ELSE 'City layer' END AS haystack
FROM lineitem
"""
EDITORIAL = """
SELECT c_custkey AS poi_id, CASE c_mktsegment WHEN 'MACHINERY' THEN 'featured' WHEN 'BUILDING' THEN 'approved' ELSE 'draft' END AS editorial_status,
  CAST(c_custkey % 9 - 2 AS INT) AS boost, CASE WHEN c_custkey % 13 = 0 THEN c_name WHEN c_custkey % 13 = 1 THEN '' ELSE NULL END AS title
FROM customer
"""
DECISIONS = """
SELECT poi_id, theme, decision, reviewed_at FROM (
  SELECT o_custkey AS poi_id, CASE o_orderkey % 3 WHEN 0 THEN 'water' WHEN 1 THEN 'rail' ELSE 'public_memory' END AS theme,
    CASE o_orderstatus WHEN 'F' THEN 'force_exclude' WHEN 'P' THEN 'force_include' ELSE 'none' END AS decision, o_orderdate AS reviewed_at,
    row_number() OVER (PARTITION BY o_custkey, o_orderkey % 3 ORDER BY o_orderdate DESC, o_orderkey DESC) AS k
  FROM orders) AS d WHERE k = 1
"""
MEMBERSHIPS = """
SELECT poi_id, theme, CASE WHEN h % 10 < 7 THEN 'accepted' ELSE 'candidate' END AS status, CASE WHEN h % 2 = 0 THEN 'rule' ELSE 'mixed' END AS basis,
  CAST(60 + h % 36 AS DOUBLE) / CAST(100 AS DOUBLE) AS confidence
FROM (SELECT p_partkey AS poi_id, 'water' AS theme, p_partkey AS h FROM part WHERE p_partkey % 4 = 0
  UNION ALL SELECT p_partkey AS poi_id, 'rail' AS theme, p_partkey + 3 AS h FROM part WHERE p_partkey % 5 < 2) AS m
"""
SNAPSHOTS = """
SELECT 'events' AS source_name, CAST(user_id AS STRING) AS record_id, ts AS fetched_at, event_id AS seq, event_type AS content_hash FROM events
"""


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A view over the tables that its SQL names."""
    text = sql
    frames = {}
    for t in ("part", "lineitem", "customer", "orders", "events"):
        if f"FROM {t}" in text:
            text = text.replace(f"FROM {t}", f"FROM {{{t}}}")
            frames[t] = spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return spark.sql(text, **frames)


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, EVIDENCE)


def places(spark: SparkSession, sf_dir: str, signals: bool = True, only: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """A place frame: with tags as a map, Mercator coordinates, and with signals the evidence roll-up and editorial rows. only: keeps some of the
    places; then evidence of other places is left out before it is summed."""
    poi = view(spark, sf_dir, POI)
    names = ("historic", "railway", "waterway", "tourism", "natural", "man_made")
    tags = F.map_filter(F.create_map(*(x for n in names for x in (F.lit(n), F.col(f"tag_{n}")))), lambda k, v: v.isNotNull())
    display = F.array_distinct(F.array_compact(F.array("category", "secondary")))
    poi = poi.withColumns({"tags": tags, "display": display, "x": geo.mercator_x(F.col("lon")), "y": geo.mercator_y(F.col("lat"))})
    poi = poi.withColumnsRenamed({"category": "normalized_category", "subcategory": "normalized_subcategory"}).drop("secondary", *(f"tag_{n}" for n in names))
    if only:
        poi = only(poi).select(*poi.columns)
    if not signals:
        return poi
    seen = evidence(spark, sf_dir)
    sig = rollup(seen.join(poi.select("poi_id"), "poi_id", "left_semi") if only else seen).withColumn("genericity", F.when(F.col("poi_id") % 10 == 0, 0.15).otherwise(0.0))
    return poi.join(sig, "poi_id", "left").join(view(spark, sf_dir, EDITORIAL), "poi_id", "left")
