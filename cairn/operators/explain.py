"""Reasons and badges, worked out after the limit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairn.functions import vocab


def _yes(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def reasons(mode: str, theme: str | None = None) -> Column:
    """The first three reasons of a scored result, or a fallback. mode: nearby or route. Flags: historical, cultural,
    scenic, infrastructure; has_wikidata; boost."""
    fits = {"nearby": (F.col, ("point_proximity", "radius_fit")), "route": (F.col, ("route_proximity", "detour_fit", "budget_fit"))}[mode][1]
    fit = sum((F.col(c) for c in fits[1:]), F.col(fits[0]))
    found = F.array_compact(
        F.array(
            F.when(F.col("match_type") == "primary", "strong primary match for the requested category").when(F.col("match_type") == "secondary", f"secondary category match supported by {'route fit' if mode == 'route' else 'proximity'}"),
            F.when(fit >= 22.0, "close to the route with manageable detour burden" if mode == "route" else "very close to the pinned location"),
            F.lit(vocab.THEMES[theme][2] if theme else None).cast("string"),
            F.when(F.col("significance") >= 18, "strong base significance for this landscape reading"),
            F.when(F.col("official_corroboration") >= 4, "corroborated by official city or heritage sources").when(F.col("district_membership") >= 3, "sits inside a named civic or historic district").when(F.col("institutional_identity") >= 2.5, "recognized by public cultural institution data"),
            F.when(_yes("has_wikidata"), "linked identity from structured public data"),
            F.when(_yes("infrastructure"), "reveals civic or infrastructural traces").when(_yes("cultural"), "strong local identity and cultural legibility").when(_yes("scenic"), "offers a clear terrain or landscape read").when(_yes("historical"), "anchors local historical context"),
            F.when(F.coalesce("boost", F.lit(0)) > 0, "editorially boosted candidate"),
        )
    )
    fallback = "route-plausible candidate with meaningful local signal" if mode == "route" else "nearby candidate with meaningful local signal"
    return F.when(F.size(found) > 0, F.slice(found, 1, 3)).otherwise(F.array(F.lit(fallback)))


def badges(mode: str, travel: str, theme: str | None = None) -> Column:
    d = F.col("distance_m")
    if mode == "route":
        spatial = [F.when(d <= 150, "near this route"), F.when(F.col("detour_m") <= 500, "within budget")]
    else:
        spatial = [F.when(d <= 100, "near this location"), F.when((d <= 400) if travel == "walking" else F.lit(False), "walkable"), F.when((d <= 1200) if travel == "driving" else F.lit(False), "short drive")]
    flag = F.when(_yes("infrastructure"), "infrastructure trace").when(_yes("scenic"), "scenic").when(_yes("cultural"), "cultural signal").when(_yes("historical"), "history")
    rest = [F.when(F.col("editorial_status") == "featured", "featured"), F.when(F.col("official") >= 0.7, "officially corroborated"), F.lit(vocab.THEMES[theme][3] if theme else None).cast("string"), flag]
    return F.array_compact(F.array(*spatial, *rest))


def why_not_linked() -> Column:
    """What a reviewer reads about a register row that wasn't linked by itself. Columns: status, resolved_name,
    resolution_method, best_name, best_similarity, match_strategy. The wording is fixed."""
    name = F.coalesce("resolved_name", "best_name")
    resolved = F.format_string("Resolved manually to '%s' via %s.", name, F.coalesce("resolution_method", F.lit("manual review")))
    best = F.format_string("Best candidate '%s' via %s scored %.3f, below the auto-link threshold.", F.col("best_name"), F.coalesce("match_strategy", F.lit("fuzzy_fallback")), F.coalesce("best_similarity", F.lit(0.0)))
    found = F.when(F.col("status") == "resolved", resolved).when(F.col("status") == "suppressed", "Suppressed during editorial review.")
    return found.when(F.col("best_name").isNull(), "No plausible canonical POI candidate was found.").otherwise(best)


def detail_reasons() -> Column:
    """The first three reasons of a place shown by itself, without a request. Columns: historical, cultural, infrastructure, official, has_wikidata."""
    found = F.array_compact(
        F.array(
            F.when(_yes("historical"), "historical significance signal present"),
            F.when(_yes("cultural"), "strong local identity or cultural context"),
            F.when(_yes("infrastructure"), "reveals civic or infrastructural traces"),
            F.when(F.col("official") >= 0.7, "corroborated by official city or heritage sources"),
            F.when(_yes("has_wikidata"), "structured external identity match"),
        )
    )
    return F.when(F.size(found) > 0, F.slice(found, 1, 3)).otherwise(F.array(F.lit("candidate requires editorial review")))


def detail_badges() -> Column:
    """Badges of a place shown by itself. Columns: editorial_status, official, historical, scenic, infrastructure, primary_source."""
    return F.array_compact(
        F.array(
            F.when(F.col("editorial_status") == "featured", "featured"),
            F.when(F.col("official") >= 0.7, "officially corroborated"),
            F.when(_yes("historical"), "history"),
            F.when(_yes("scenic"), "scenic"),
            F.when(_yes("infrastructure"), "infrastructure trace"),
            F.when(F.col("primary_source") == "osm_overpass", "osm-ingested"),
        )
    )
