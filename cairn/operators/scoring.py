"""Ranking of places near a point or along a route: named components of two decimals, their exact sum, the k best.

A place frame has: poi_id, canonical_name, x, y (Mercator metres), normalized_category, normalized_subcategory, display
(array of categories), tags (map), is_active, city, base_significance, quality_score, walk_affinity, drive_affinity; from
signals official, district, institutional, genericity (null: no signals row); from editorial boost, title (null: none).
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions import geo, vocab
from cairn.functions.rounding import py_round, total
from cairn.functions.text import has_any

SPEED = {"driving": 250.0, "walking": 80.0}


def _check(category: str, theme: str | None, mode: str, limit: int) -> None:
    if category not in vocab.CATEGORIES:
        raise ValueError(f"unknown category: {category}")
    if theme is not None and not vocab.THEMES.get(theme, ("", False))[1]:
        raise ValueError(f"no theme that queries can name: {theme}")
    if mode not in SPEED:
        raise ValueError(f"unknown travel mode: {mode}")
    if not 1 <= limit <= 20:
        raise ValueError("limit must be 1 to 20")


@dataclass(frozen=True)
class Nearby:
    lon: float
    lat: float
    radius_m: int
    category: str = "mixed"
    mode: str = "walking"
    theme: str | None = None
    city: str | None = None
    limit: int = 10

    def __post_init__(self) -> None:
        _check(self.category, self.theme, self.mode, self.limit)
        if self.radius_m <= 0:
            raise ValueError("radius must be positive")


@dataclass(frozen=True)
class Route:
    line: tuple[tuple[float, float], ...]
    max_detour_m: int
    max_extra_min: int
    category: str = "mixed"
    mode: str = "driving"
    theme: str | None = None
    city: str | None = None
    limit: int = 5

    def __post_init__(self) -> None:
        _check(self.category, self.theme, self.mode, self.limit)
        if len(self.line) < 2:
            raise ValueError("a route needs two points")
        if self.max_detour_m <= 0 or self.max_extra_min <= 0:
            raise ValueError("budgets must be positive")


def is_tag(key: str, *values: str) -> Column:
    return F.coalesce(F.try_element_at("tags", F.lit(key)).isin(*values), F.lit(False))


def has_tag(*keys: str) -> Column:
    out = F.lit(False)
    for k in keys:
        out = out | F.map_contains_key("tags", k)
    return out


def _lower_name() -> Column:
    return F.lower(F.coalesce("canonical_name", F.lit("")))


def match_type(category: str) -> Column:
    if category == "mixed":
        return F.lit("mixed")
    return F.when(F.col("normalized_category") == category, "primary").when(F.array_contains("display", category), "secondary").otherwise("none")


def route_match_type(category: str) -> Column:
    """As match_type, but one chapel counts as primary history on routes."""
    plain = match_type(category)
    if category != "history":
        return plain
    named = _lower_name().isin("san miguel", "san miguel chapel") | F.coalesce(F.lower("title").isin("san miguel", "san miguel chapel"), F.lit(False))
    chapel = named & (F.col("normalized_subcategory") == "ritual_religious_site") & F.array_contains("display", "history")
    return F.when((plain == "secondary") & F.coalesce(chapel, F.lit(False)), "primary").otherwise(plain)


def eligible(category: str) -> Column:
    """Scenic results must be views, landscape, or trails with a view, nature or water."""
    if category != "scenic":
        return F.lit(True)
    kind = F.coalesce("normalized_subcategory", F.lit(""))
    return kind.isin("overlook_vista", "landscape_feature") | ((kind == "trail_river_access") & (is_tag("tourism", "viewpoint") | has_tag("natural", "waterway")))


def category_matches(category: str) -> Column:
    return (match_type(category) != "none") & eligible(category)


def base_components(mode: str, weights: Mapping[str, float] | None = None) -> dict[str, Column]:
    """What a place is worth wherever it lies. weights: those that differ from vocab.WEIGHTS, by its names."""
    if unknown := set(weights or ()) - set(vocab.WEIGHTS):
        raise ValueError(f"unknown weights: {sorted(unknown)}")
    w = vocab.WEIGHTS | dict(weights or {})
    affinity = F.col("drive_affinity" if mode == "driving" else "walk_affinity")

    def signal(name: str, weight: float) -> Column:
        return py_round(F.coalesce(F.col(name), F.lit(0.0)) * weight, 2)

    return {
        "significance": py_round(F.col("base_significance") / 100.0 * w["significance"], 2),
        "quality": py_round(F.col("quality_score") / 100.0 * w["quality"], 2),
        "mode_affinity": py_round(affinity * w["mode"], 2),
        "official_corroboration": signal("official", w["official"]),
        "district_membership": signal("district", w["district"]),
        "institutional_identity": signal("institutional", w["institutional"]),
        "editorial_boost": F.coalesce(F.col("boost").cast("double"), F.lit(0.0)),
        "penalties": -signal("genericity", w["generic"]) + F.lit(0.0),
    }


def is_history_anchor() -> Column:
    named = _lower_name().isin(*vocab.HISTORY_ANCHORS)
    chapel = (_lower_name() == "san miguel") & (F.col("normalized_subcategory") == "ritual_religious_site") & is_tag("historic", "building", "church")
    historic = F.array_contains("display", "history") | (F.col("normalized_category") == "history")
    return F.coalesce(historic & (named | chapel), F.lit(False))


def is_rail_anchor() -> Column:
    name = _lower_name()
    yard = has_any(name, ("railyard", "rail yard")) & F.coalesce(F.col("normalized_subcategory").isin("historic_district", "infrastructure_landmark"), F.lit(False))
    return is_tag("historic", "railway_station") | is_tag("railway", "station", "yard") | has_any(name, ("depot", "station")) | yard


def is_rule_only_rail_trace() -> Column:
    """Infrastructure or a trail that is rail by rule alone. Columns: rail_basis, rail_links (null: no membership)."""
    kind = F.coalesce(F.col("normalized_subcategory").isin("infrastructure_landmark", "trail_river_access"), F.lit(False))
    return kind & ~is_rail_anchor() & F.coalesce((F.col("rail_basis") == "rule") & (F.col("rail_links") == 0), F.lit(False))


def category_components(category: str) -> dict[str, Column]:
    kind, main, name = F.coalesce("normalized_subcategory", F.lit("")), F.col("normalized_category"), _lower_name()
    zero = F.lit(0.0)
    scenic = art = civic = fragment = anchor = zero
    if category == "scenic":
        trail = F.when(is_tag("tourism", "viewpoint") | has_tag("natural", "waterway"), 1.5).otherwise(-6.0)
        scenic = F.when((main != "scenic") & F.array_contains("display", "scenic"), -8.0).when(kind == "overlook_vista", 4.0).when(kind == "landscape_feature", 3.0).when(kind == "trail_river_access", trail).otherwise(0.0)
    if category == "art":
        by_kind = F.when(kind == "gallery_art_space", 3.0).when(kind == "mural_public_art", 4.0).otherwise(0.0)
        art = F.when(main == "art", by_kind + F.when(has_any(name, ("canyon", "gallery", "art", "studio")), 1.0).otherwise(0.0)).otherwise(0.0)
    if category == "civic":
        rail = is_tag("historic", "railway_station") | has_any(name, ("rail", "railway", "depot", "railyard", "acequia"))
        civic = F.when((main == "history") & F.array_contains("display", "civic") & rail, 10.0).otherwise(0.0)
        fragment = F.when((main == "civic") & (kind == "infrastructure_landmark") & has_any(name, ("bridge", "grid vent", "tunnel vent")), -5.0).otherwise(0.0)
    if category == "history":
        anchor = F.when(is_history_anchor(), 6.0).otherwise(0.0)
    return {"scenic_specificity": scenic, "art_anchor_bonus": art, "civic_anchor_bonus": civic, "civic_fragment_penalty": fragment, "history_anchor_bonus": anchor}


def theme_components(category: str, theme: str | None) -> dict[str, Column]:
    bonus = trace = F.lit(0.0)
    if theme == "rail" and category == "mixed":
        bonus = F.when(is_rail_anchor(), 4.0).otherwise(0.0)
        trace = F.when(is_rule_only_rail_trace(), -3.0).otherwise(0.0)
    return {"rail_anchor_bonus": bonus, "rail_trace_guardrail": trace}


def category_bonus(match: Column) -> Column:
    return F.when(match == "primary", 10.0).when(match == "secondary", 2.5).otherwise(0.0)


def guardrail(match: Column, fit: Column, high: float, low: float) -> Column:
    """What a secondary match loses unless it fits well; fit is unrounded."""
    return F.when(match != "secondary", 0.0).when(fit >= high, 0.0).when(fit >= low, -1.0).otherwise(-2.0)


def travel_minutes(metres: Column, mode: str) -> Column:
    return F.greatest(F.lit(1), F.rint(metres / SPEED[mode]).cast("int"))


def _themed(places: DataFrame, theme: str | None) -> DataFrame:
    """Only members of the theme by its effective status. places needs theme_status if a theme is asked for."""
    return places if theme is None else places.where(F.col("theme_status") == "accepted")


def _open_places(places: DataFrame, city: str | None, theme: str | None) -> DataFrame:
    out = places.where("is_active")
    return _themed(out if city is None else out.where(F.col("city") == city), theme)


def near_point(places: DataFrame, req: Nearby) -> DataFrame:
    """Places within the radius, by a box that the scan can use, the exact distance, and the rounded one."""
    at = geo.project(req.lon, req.lat)
    d = geo.distance(F.col("x"), F.col("y"), *at)
    rows = _open_places(places, req.city, req.theme).where(geo.in_box(F.col("x"), F.col("y"), [at], req.radius_m)).where(d <= req.radius_m)
    return rows.withColumn("distance_m", F.rint(d).cast("int")).where(F.col("distance_m") <= req.radius_m)


def along_route(places: DataFrame, req: Route) -> DataFrame:
    """Places within the detour of the route, then within the budgets of detour (there and back) and minutes."""
    line = [geo.project(*p) for p in req.line]
    d = geo.line_distance(F.col("x"), F.col("y"), line)
    rows = _open_places(places, req.city, req.theme).where(geo.in_box(F.col("x"), F.col("y"), line, req.max_detour_m)).where(d <= req.max_detour_m)
    rows = rows.withColumn("distance_m", F.rint(d).cast("int")).withColumn("detour_m", F.col("distance_m") * 2)
    rows = rows.withColumn("extra_min", travel_minutes(F.col("detour_m"), req.mode))
    return rows.where((F.col("detour_m") <= req.max_detour_m) & (F.col("extra_min") <= req.max_extra_min))


def _scored(rows: DataFrame, spatial: dict[str, Column], match: Column, guard: Column, category: str, theme: str | None, mode: str, more: dict[str, Column], weights: Mapping[str, float] | None) -> DataFrame:
    parts = {k: py_round(v, 2) for k, v in spatial.items()} | base_components(mode, weights) | category_components(category) | theme_components(category, theme) | more
    parts |= {"category_bonus": category_bonus(match), "category_intent_guardrail": guard}
    rows = rows.withColumn("match_type", match).withColumns(parts)
    return rows.withColumn("score", total(*map(F.col, parts)))


def score_nearby(places: DataFrame, req: Nearby, weights: Mapping[str, float] | None = None) -> DataFrame:
    rows = near_point(places, req).where(category_matches(req.category))
    share = F.col("distance_m") / float(req.radius_m)
    spatial = {"point_proximity": F.greatest(F.lit(0.0), 18.0 - 18.0 * share), "radius_fit": F.greatest(F.lit(0.0), 12.0 - 12.0 * share)}
    match = match_type(req.category)
    guard = guardrail(match, spatial["point_proximity"] + spatial["radius_fit"], 24.0, 18.0)
    prominence = F.when(is_rail_anchor(), 8.0).otherwise(0.0) if req.theme == "rail" and req.category == "mixed" else F.lit(0.0)
    return _scored(rows, spatial, match, guard, req.category, req.theme, req.mode, {"nearby_rail_anchor_prominence": prominence}, weights)


def score_route(places: DataFrame, req: Route, weights: Mapping[str, float] | None = None) -> DataFrame:
    rows = along_route(places, req).where(category_matches(req.category))
    corridor = float(max(120, int(req.max_detour_m * 0.8)))
    detour = F.col("detour_m") / float(req.max_detour_m)
    room = (F.greatest(F.lit(0), req.max_detour_m - F.col("detour_m")) / float(req.max_detour_m) + F.greatest(F.lit(0), req.max_extra_min - F.col("extra_min")) / float(req.max_extra_min)) / 2.0 * 5.0
    spatial = {"route_proximity": F.greatest(F.lit(0.0), 15.0 - F.col("distance_m") / corridor * 15.0), "detour_fit": F.greatest(F.lit(0.0), 15.0 - detour * 15.0), "budget_fit": room}
    match = route_match_type(req.category)
    guard = guardrail(match, spatial["route_proximity"] + spatial["detour_fit"] + spatial["budget_fit"], 28.0, 24.0)
    return _scored(rows, spatial, match, guard, req.category, req.theme, req.mode, {}, weights)


def best(scored: DataFrame, limit: int) -> DataFrame:
    """The highest scores; ties go to the smaller poi_id."""
    return scored.orderBy(F.col("score").desc(), "poi_id").limit(limit)
