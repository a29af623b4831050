"""Theme memberships: evaluation, merging with stored ones, editorial decisions, review state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions import vocab
from cairn.functions.rounding import py_round
from cairn.functions.text import has_any
from cairn.operators.scoring import has_tag, is_tag


def theme_evidence(evidence: DataFrame) -> DataFrame:
    """poi_id, water_ids, rail_ids: sorted ids of evidence that mentions a theme's words. evidence: poi_id, evidence_id,
    and the texts to search as one column haystack."""
    text = F.lower(F.coalesce("haystack", F.lit("")))

    def ids(words: tuple[str, ...]) -> Column:
        return F.array_sort(F.collect_set(F.when(has_any(text, words), F.col("evidence_id"))))

    return evidence.groupBy("poi_id").agg(ids(vocab.WATER_WORDS).alias("water_ids"), ids(vocab.RAIL_WORDS).alias("rail_ids"))


def _names() -> Column:
    """Canonical name and aliases in lower case, kept apart by a line feed."""
    return F.lower(F.concat_ws("\n", F.coalesce("canonical_name", F.lit("")), "aliases"))


def _closed(places: DataFrame, theme: str, direct: Column, confidence: Column, reasons: list[Column], ids: Column) -> DataFrame:
    score = py_round(F.least(confidence + F.least(F.lit(0.2), 0.1 * F.size(ids)), F.lit(0.95)), 2)
    found = places.where(direct).select("poi_id", F.lit(theme).alias("theme"), score.alias("confidence"), F.array_join(F.array_distinct(F.array_compact(F.array(*reasons))), "; ").alias("rationale"), ids.alias("evidence_ids"))
    basis = F.when(F.size("evidence_ids") > 0, "mixed").otherwise("rule")
    return found.withColumns({"status": F.when(F.col("confidence") >= 0.6, "accepted").otherwise("candidate"), "basis": basis})


def water(places: DataFrame) -> DataFrame:
    """places: a place frame with aliases (array) and water_ids (array)."""
    kind, main = F.coalesce("normalized_subcategory", F.lit("")), F.coalesce("normalized_category", F.lit(""))
    canal, stream = is_tag("man_made", "canal"), has_tag("waterway")
    name = _names().contains("acequia") & (kind.isin("infrastructure_landmark", "trail_river_access") | main.isin("civic", "scenic"))
    direct = canal | stream | name
    trail, infra = (kind == "trail_river_access") & stream, (kind == "infrastructure_landmark") & direct
    confidence = F.when(canal, 0.7).otherwise(0.0) + F.when(stream, 0.65).otherwise(0.0) + F.when(name, 0.65).otherwise(0.0) + F.when(trail, 0.1).when(infra, 0.05).otherwise(0.0)
    reasons = [
        F.when(canal, "OSM marks this place as a canal trace"),
        F.when(stream, F.concat(F.lit("OSM waterway signal is present ("), F.try_element_at("tags", F.lit("waterway")), F.lit(")"))),
        F.when(name, "Canonical or alias naming explicitly references an acequia"),
        F.when(trail, "Subtype reinforces a water-access reading").when(infra, "Infrastructure subtype fits a water-systems interpretation"),
        F.when(F.size("water_ids") > 0, "Linked evidence references water corridor terms"),
    ]
    return _closed(places, "water", direct, confidence, reasons, F.col("water_ids"))


def rail(places: DataFrame) -> DataFrame:
    """places: a place frame with aliases (array) and rail_ids (array)."""
    kind, main = F.coalesce("normalized_subcategory", F.lit("")), F.coalesce("normalized_category", F.lit(""))
    line, station = has_tag("railway"), is_tag("historic", "railway_station")
    guard = kind.isin("historic_site", "historic_district", "infrastructure_landmark", "trail_river_access", "civic_space_plaza") | main.isin("history", "civic", "scenic")
    name = has_any(_names(), vocab.RAIL_NAMES) & guard
    direct = line | station | name
    site = kind.isin("historic_site", "historic_district", "infrastructure_landmark") & direct
    trail = (kind == "trail_river_access") & has_any(_names(), ("rail trail", "railyard", "rail yard"))
    confidence = F.when(line, 0.75).otherwise(0.0) + F.when(station, 0.7).otherwise(0.0) + F.when(name, 0.65).otherwise(0.0) + F.when(site | trail, 0.05).otherwise(0.0)
    reasons = [
        F.when(line, F.concat(F.lit("OSM railway signal is present ("), F.try_element_at("tags", F.lit("railway")), F.lit(")"))),
        F.when(station, "OSM historic tagging identifies a railway station"),
        F.when(name, "Canonical or alias naming explicitly references rail infrastructure"),
        F.when(site, "Subtype reinforces a rail-infrastructure or depot reading").when(trail, "Subtype supports a repurposed rail-corridor reading"),
        F.when(F.size("rail_ids") > 0, "Linked evidence references a railyard, depot, or rail designation"),
    ]
    return _closed(places, "rail", direct, confidence, reasons, F.col("rail_ids"))


EVALUATORS: dict[str, Callable[[DataFrame], DataFrame]] = {"water": water, "rail": rail}


def evaluated(places: DataFrame) -> DataFrame:
    out = None
    for make in EVALUATORS.values():
        out = make(places) if out is None else out.unionByName(make(places))
    return out


def merged(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """stored memberships brought up to fresh: every key of either with its action. computed_at moves only on a real change."""
    keys, values = ["poi_id", "theme"], ["status", "basis", "confidence", "rationale"]
    s = stored.select(*keys, F.struct(*values).alias("old"), F.col("computed_at").alias("old_at"))
    n = fresh.select(*keys, F.struct(*values).alias("new"))
    both = s.join(n, keys, "full")
    action = F.when(F.col("new").isNull(), "delete").when(F.col("old").isNull(), "insert").when(F.col("old") == F.col("new"), "keep").otherwise("update")
    return both.select(*keys, action.alias("action"), *(F.coalesce(f"new.{v}", f"old.{v}").alias(v) for v in values), "old_at")


def link_changes(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Evidence links (poi_id, theme, evidence_id) to add and to take away."""
    keys = ["poi_id", "theme", "evidence_id"]
    gone = stored.select(*keys).distinct().join(fresh.select(*keys), keys, "left_anti").withColumn("action", F.lit("unlink"))
    return gone.unionByName(fresh.select(*keys).distinct().join(stored.select(*keys), keys, "left_anti").withColumn("action", F.lit("link")))


def effective(memberships: DataFrame, decisions: DataFrame) -> DataFrame:
    """What holds after editorial decisions, for every place and theme with a membership or a decision: effective_status, _confidence (of two places), _basis and
    _rationale. A decision that keeps a theme out or brings it in explains itself by its notes. memberships may have rationale, decisions may have notes. The two sentences are fixed."""
    both = memberships.join(decisions, ["poi_id", "theme"], "full")
    text = lambda df, c: F.nullif(c, F.lit("")) if c in df.columns else F.lit(None).cast("string")
    out, into = F.col("decision") == "force_exclude", F.col("decision") == "force_include"
    none, own = F.col("status").isNull(), py_round(F.col("confidence"), 2)
    status = F.when(out, "suppressed").when(into, "accepted").otherwise(F.coalesce("status", F.lit("none")))
    confidence = F.when(out, F.coalesce(own, F.lit(0.0))).when(into, F.greatest(F.coalesce(own, F.lit(1.0)), F.lit(0.9))).otherwise(own)
    basis = F.when(out, F.coalesce("basis", F.lit("editorial"))).when(into, F.when(none, "editorial").otherwise("mixed")).otherwise(F.col("basis"))
    notes = text(decisions, "notes")
    rationale = F.when(out, F.coalesce(notes, F.lit("Suppressed by editorial review."))).when(into, F.coalesce(notes, F.lit("Included by editorial review."))).when(~none, F.coalesce(text(memberships, "rationale"), F.lit("")))
    return both.withColumns({"effective_status": status, "effective_confidence": confidence, "effective_basis": basis, "effective_rationale": rationale})


def review_state(reviewed_at: Column, has_membership: Column, stamp: Column, computed_at: Column) -> Column:
    return F.when(reviewed_at.isNull(), "unreviewed").when(~has_membership, "reviewed").when(stamp.eqNullSafe(computed_at), "reviewed").otherwise("stale")


def queue(memberships: DataFrame, decisions: DataFrame, places: DataFrame, links: DataFrame, theme: str | None = None, city: str | None = None, status: str | None = None, state: str | None = None, decision: str | None = None, limit: int = 100) -> DataFrame:
    """What a reviewer of themes sees: every place and theme with a membership or a decision, what isn't reviewed first, then stale rows, candidates before accepted ones, the least confident, by name, poi_id and
    theme. status: only memberships of that status; decision: only such decisions; state: unreviewed, reviewed or stale. memberships: poi_id, theme, status, basis, confidence, computed_at; decisions: poi_id, theme, decision,
    reviewed_at, stamp (computed_at of the membership that was seen); places: poi_id, canonical_name, city, category; links: poi_id, theme, evidence_id. Filters come before the joins that they allow."""
    pick = lambda df: df if theme is None else df.where(F.col("theme") == theme)
    m, d = pick(memberships), pick(decisions)
    m = m if status is None else m.where(F.col("status") == status)
    d = d if decision is None else d.where(F.col("decision") == decision)
    how = {(True, True): "full", (False, True): "left", (True, False): "right", (False, False): "inner"}[(status is None, decision is None)]
    keys = ["poi_id", "theme"]
    rows = m.withColumn("member", F.lit(True)).join(d.withColumn("decided", F.lit(True)), keys, how)
    rows = rows.withColumn("review_state", review_state(F.col("reviewed_at"), F.coalesce("member", F.lit(False)), F.col("stamp"), F.col("computed_at")))
    rows = rows if state is None else rows.where(F.col("review_state") == state)
    at = places if city is None else places.where(F.col("city") == city)
    rows = rows.join(at.select("poi_id", "canonical_name", "city", "category"), "poi_id")
    order = lambda c, *values: F.coalesce(F.array_position(F.array(*map(F.lit, values)), F.col(c)), F.lit(0))
    last = lambda p, n: F.when(p == 0, n).otherwise(p)
    confidence = py_round(F.col("confidence"), 2)
    first = (last(order("review_state", "unreviewed", "stale", "reviewed"), 4), last(order("status", "candidate", "accepted"), 3), F.coalesce(confidence, F.lit(1.0)), F.lower("canonical_name"), "poi_id", "theme")
    top = rows.withColumn("automated_confidence", confidence).orderBy(*first).limit(limit)
    counts = pick(links).join(top.select(*keys), keys, "left_semi").groupBy(*keys).agg(F.count_distinct("evidence_id").alias("evidence_count"))
    label = F.create_map(*(F.lit(x) for t, spec in vocab.THEMES.items() for x in (t, spec[0])))[F.col("theme")]
    held = F.when(F.col("decision") == "force_exclude", "suppressed").when(F.col("decision") == "force_include", "accepted").otherwise(F.col("status"))
    return top.join(counts, keys, "left").select(
        *keys, F.coalesce(label, "theme").alias("label"), "canonical_name", "city", "category", F.col("status").alias("automated_status"), F.col("basis").alias("automated_basis"), "automated_confidence",
        F.when(F.col("member"), F.coalesce("evidence_count", F.lit(0))).otherwise(F.lit(0)).alias("evidence_count"), "computed_at", F.col("decision").alias("editorial_decision"), "review_state", "reviewed_at", held.alias("effective_status"),
    )
