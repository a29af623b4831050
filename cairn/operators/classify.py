"""From raw map elements to typed places: first matching rule, display categories, scores, geometry, audit."""

from __future__ import annotations

from functools import reduce
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions import geo, vocab
from cairn.functions.text import description_quality, poor_description, slug, type_template
from cairn.operators.scoring import has_tag, is_tag


def _name() -> Column:
    return F.lower(F.coalesce(F.try_element_at("tags", F.lit("name")), F.lit("")))


def _fits(required: dict[str, str]) -> Column:
    return reduce(lambda a, b: a & b, [has_tag(k) if v == "*" else is_tag(k, v) for k, v in required.items()])


def rule() -> Column:
    """struct rule, kind of the first rule that a row's tags (map) meet; null if none. No row moves for it."""
    acequia_art = _name().contains("acequia") & is_tag("tourism", "artwork") & is_tag("artwork_type", "mural", "installation")
    found = [
        F.when(is_tag("leisure", "park") & _name().contains("plaza"), F.struct(F.lit("park_named_plaza").alias("rule"), F.lit("civic_space_plaza").alias("kind"))),
        F.when(acequia_art, F.struct(F.lit("acequia_named_artwork_override").alias("rule"), F.lit("infrastructure_landmark").alias("kind"))),
    ]
    return F.coalesce(*found, *(F.when(_fits(tags), F.struct(F.lit(name).alias("rule"), F.lit(kind).alias("kind"))) for name, kind, tags in vocab.TAG_RULES))


def _by_type(place: int, kind: Column) -> Column:
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v[place])) for k, v in vocab.TYPES.items()))[kind]


def public_category(kind: Column) -> Column:
    return _by_type(0, kind)


def display_categories(kind: Column, category: Column) -> Column:
    """The category, then all others that the type or the tags add, in a fixed order."""
    add = {
        "history": has_tag("historic") | kind.isin("historic_site", "historic_district", "museum"),
        "culture": kind.isin("ritual_religious_site", "performance_cultural_venue", "neighborhood_corridor", "market_food_identity") | (has_tag("place", "amenity") & (category != "food")),
        "art": kind.isin("mural_public_art", "gallery_art_space") | (is_tag("tourism", "artwork") & (kind == "infrastructure_landmark") & _name().contains("acequia")),
        "scenic": kind.isin("overlook_vista", "trail_river_access", "landscape_feature") | is_tag("tourism", "viewpoint"),
        "food": (kind == "market_food_identity") | is_tag("amenity", "marketplace"),
        "civic": kind.isin("civic_space_plaza", "infrastructure_landmark") | has_tag("man_made", "railway") | is_tag("highway", "pedestrian") | is_tag("historic", "railway_station"),
    }
    return F.array_distinct(F.array_compact(F.array(category, *(F.when(add[c], c) for c in vocab.DISPLAY_ORDER))))


def with_named_history(display: Column, name: Column) -> Column:
    """The plaza shows history second."""
    plaza = F.lower(name).isin("the santa fe plaza", "santa fe plaza") & ~F.array_contains(display, "history")
    return F.when(F.coalesce(plaza, F.lit(False)), F.array_insert(display, F.lit(2), F.lit("history"))).otherwise(display)


def significance(kind: Column) -> Column:
    points = [(has_tag("wikidata"), 4.0), (has_tag("wikipedia"), 3.0), (is_tag("historic", "yes", "monument", "memorial"), 2.0)]
    return reduce(lambda a, p: a + F.when(p[0], p[1]).otherwise(0.0), points, _by_type(2, kind))


def quality() -> Column:
    points = [(has_tag("name"), 10.0), (has_tag("wikidata"), 5.0), (has_tag("wikipedia"), 5.0)]
    return F.least(F.lit(95.0), reduce(lambda a, p: a + F.when(p[0], p[1]).otherwise(0.0), points, 40.0 + F.least(F.size("tags"), F.lit(12)) * 2.5))


def affinity(mode: str, kind: Column) -> Column:
    return _by_type(3 if mode == "walking" else 4, kind)


def point_of_element() -> Column:
    """struct x (longitude), y: of a node itself, of a line or area its centre, else the given centre or the bounds' middle."""
    ring = F.transform("geometry", lambda p: F.struct(p["lon"].alias("x"), p["lat"].alias("y")))
    n = F.size("geometry")
    closed = (n >= 4) & (F.get("geometry", F.lit(0)) == F.get("geometry", n - 1))
    at = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return (
        F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), at(F.col("lon"), F.col("lat")))
        .when(closed, geo.ring_centroid(ring))
        .when(n >= 2, geo.line_centroid(ring))
        .when(n == 1, F.get(ring, F.lit(0)))
        .when(F.col("center").isNotNull(), at(F.col("center.lon"), F.col("center.lat")))
        .when(F.col("bounds").isNotNull(), at((F.col("bounds.minlon") + F.col("bounds.maxlon")) / 2, (F.col("bounds.minlat") + F.col("bounds.maxlat")) / 2))
    )


def audited(elements: DataFrame) -> DataFrame:
    """Every element with its status and, if it is classified, all derived fields: places are the rows of that status."""
    tags = F.map_filter("tags", lambda k, v: v.isNotNull())
    rows = elements.withColumn("tags", F.coalesce(tags, F.create_map().cast("map<string,string>"))).withColumn("match", rule())
    name = F.trim(F.coalesce(F.try_element_at("tags", F.lit("name")), F.lit("")))
    status = F.when(name == "", "skipped_missing_name").when(F.col("match").isNull(), "skipped_unclassified").otherwise("classified")
    rows = rows.withColumns({"status": status, "canonical_name": name, "rule": F.col("match.rule"), "kind": F.col("match.kind")}).drop("match")
    rows = rows.withColumn("category", public_category(F.col("kind"))).withColumn("centre", point_of_element())
    described = F.trim(F.substring(F.try_element_at("tags", F.lit("description")), 1, 220))
    return rows.withColumns(
        {
            "record_id": F.concat_ws("/", "type", F.col("id").cast("string")),
            "display": with_named_history(display_categories(F.col("kind"), F.col("category")), F.col("canonical_name")),
            "base_significance": significance(F.col("kind")),
            "quality_score": quality(),
            "walk_affinity": affinity("walking", F.col("kind")),
            "drive_affinity": affinity("driving", F.col("kind")),
            "short_description": F.when(~poor_description(described), described).otherwise(type_template(F.col("kind"))),
            "slug": slug(F.concat_ws("-", "canonical_name", "type", F.col("id").cast("string"))),
            "tag_summary": F.map_filter("tags", lambda k, v: k.isin(*vocab.SUMMARY_TAGS)),
            "lon": F.col("centre.x"), "lat": F.col("centre.y"),
        }
    )


def first_signals(places: DataFrame) -> DataFrame:
    """Signals of a place as ingested, before any evidence."""
    shows = lambda *cs: F.arrays_overlap("display", F.array(*map(F.lit, cs)))
    local = F.when(shows("culture") | (F.col("kind") == "infrastructure_landmark"), 0.6).otherwise(0.4)
    return places.select(
        "record_id", F.map_contains_key("tags", F.lit("wikidata")).alias("has_wikidata"), F.map_contains_key("tags", F.lit("wikipedia")).alias("has_wikipedia"),
        F.size("tags").cast("double").alias("tag_richness"), description_quality(F.col("short_description"), F.col("kind")).alias("description_quality"),
        local.alias("local_identity"), (F.col("base_significance") / 10).alias("interpretive_value"), F.when(shows("food", "history"), 0.0).otherwise(0.15).alias("genericity"),
        F.when(F.col("quality_score") >= 65, 0.7).otherwise(0.4).alias("editorial_seed"), *(F.lit(0.0).alias(c) for c in ("official", "district", "institutional")),
    )
