"""Building blocks of the SQL that the queries are held against, in DuckDB's dialect."""

from __future__ import annotations

from cairn.functions import vocab
from cairn.plans import views

VIEWS = {"poi0": views.POI, "ev": views.EVIDENCE, "ed": views.EDITORIAL, "dec": views.DECISIONS, "mem": views.MEMBERSHIPS, "snap": views.SNAPSHOTS}


def r(x: str, places: int) -> str:
    return f"(CAST(format('{{:.{places}f}}', CAST({x} AS DOUBLE)) AS DOUBLE) + 0.0)"


def _case(place: int) -> str:
    parts = []
    for kind, w in vocab.EVIDENCE.items():
        value = f"CASE WHEN property_category = 'District' THEN {w[4]} ELSE {w[1]} END" if place == 1 and w[4] else str(w[place])
        parts.append(f"WHEN '{kind}' THEN {value}")
    return "CASE evidence_type " + " ".join(parts) + " ELSE 0 END"


_HERITAGE = ", ".join(f"'{k}'" for k, w in vocab.EVIDENCE.items() if w[3])
VIEWS["sig"] = f"""SELECT poi_id, least(1.0, CAST(sum(CAST({_case(0)} AS DECIMAL(12,2))) AS DOUBLE)) AS official,
  least(1.0, CAST(sum(CAST({_case(1)} AS DECIMAL(12,2))) AS DOUBLE)) AS district,
  least(1.0, CAST(sum(CAST({_case(2)} AS DECIMAL(12,2))) AS DOUBLE)) AS institutional,
  bool_or(evidence_type IN ({_HERITAGE})) AS heritage FROM ev GROUP BY poi_id"""
VIEWS["poi"] = """SELECT p.*, radians(lon) * 6378137.0 AS x, ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137.0 AS y,
  lower(canonical_name) AS lname, coalesce(secondary, '') AS sec,
  official, district, institutional, CASE WHEN s.poi_id IS NULL THEN NULL WHEN p.poi_id % 10 = 0 THEN 0.15 ELSE 0.0 END AS genericity,
  e.poi_id IS NOT NULL AS edited, editorial_status, boost, title
  FROM poi0 p LEFT JOIN sig s ON p.poi_id = s.poi_id LEFT JOIN ed e ON p.poi_id = e.poi_id"""
_NEEDS = {"sig": ("ev",), "poi": ("poi0", "ev", "sig", "ed")}


def sql(body: str, *names: str) -> str:
    """body behind the views named and those that they need."""
    order: list[str] = []
    for n in names:
        order += [d for d in (*_NEEDS.get(n, ()), n) if d not in order]
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in order) + "\n" + body


def match(category: str) -> str:
    return "'mixed'" if category == "mixed" else f"CASE WHEN category = '{category}' THEN 'primary' WHEN sec = '{category}' THEN 'secondary' ELSE 'none' END"


SCENIC = "(subcategory IN ('overlook_vista', 'landscape_feature') OR (subcategory = 'trail_river_access' AND (tag_tourism IS NOT DISTINCT FROM 'viewpoint' OR tag_natural IS NOT NULL OR tag_waterway IS NOT NULL)))"
RAIL_ANCHOR = "(coalesce(tag_historic = 'railway_station', false) OR coalesce(tag_railway IN ('station', 'yard'), false) OR contains(lname, 'depot') OR contains(lname, 'station') OR (contains(lname, 'railyard') AND subcategory IN ('historic_district', 'infrastructure_landmark')))"


def words(column: str, tokens: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{t}')" for t in tokens) + ")"


def components(category: str, mode: str, theme: str | None = None) -> dict[str, str]:
    w = vocab.WEIGHTS
    out = {
        "significance": r(f"base_significance / 100.0 * {w['significance']}", 2),
        "quality": r(f"quality_score / 100.0 * {w['quality']}", 2),
        "mode_affinity": r(f"{'drive' if mode == 'driving' else 'walk'}_affinity * {w['mode']}", 2),
        "official_corroboration": r(f"coalesce(official, 0.0) * {w['official']}", 2),
        "district_membership": r(f"coalesce(district, 0.0) * {w['district']}", 2),
        "institutional_identity": r(f"coalesce(institutional, 0.0) * {w['institutional']}", 2),
        "editorial_boost": "coalesce(CAST(boost AS DOUBLE), 0.0)",
        "penalties": f"(0.0 - {r(f'coalesce(genericity, 0.0) * {w['generic']}', 2)})",
    }
    zero = "CAST(0 AS DOUBLE)"
    out |= dict.fromkeys(("scenic_specificity", "art_anchor_bonus", "civic_anchor_bonus", "civic_fragment_penalty", "history_anchor_bonus"), zero)
    if category == "scenic":
        out["scenic_specificity"] = "CAST(CASE WHEN category <> 'scenic' AND sec = 'scenic' THEN -8 WHEN subcategory = 'overlook_vista' THEN 4 WHEN subcategory = 'landscape_feature' THEN 3 WHEN subcategory = 'trail_river_access' THEN CASE WHEN tag_tourism IS NOT DISTINCT FROM 'viewpoint' OR tag_natural IS NOT NULL OR tag_waterway IS NOT NULL THEN 1.5 ELSE -6 END ELSE 0 END AS DOUBLE)"
    if category == "art":
        out["art_anchor_bonus"] = f"CAST(CASE WHEN category = 'art' THEN CASE subcategory WHEN 'gallery_art_space' THEN 3 WHEN 'mural_public_art' THEN 4 ELSE 0 END + CASE WHEN {words('lname', ('canyon', 'gallery', 'art', 'studio'))} THEN 1 ELSE 0 END ELSE 0 END AS DOUBLE)"
    if category == "civic":
        out["civic_anchor_bonus"] = f"CAST(CASE WHEN category = 'history' AND sec = 'civic' AND (coalesce(tag_historic = 'railway_station', false) OR {words('lname', ('rail', 'depot', 'acequia'))}) THEN 10 ELSE 0 END AS DOUBLE)"
        out["civic_fragment_penalty"] = f"CAST(CASE WHEN category = 'civic' AND subcategory = 'infrastructure_landmark' AND {words('lname', ('bridge', 'grid vent', 'tunnel vent'))} THEN -5 ELSE 0 END AS DOUBLE)"
    out |= {"rail_anchor_bonus": zero, "rail_trace_guardrail": zero}
    if theme == "rail" and category == "mixed":
        out["rail_anchor_bonus"] = f"CAST(CASE WHEN {RAIL_ANCHOR} THEN 4 ELSE 0 END AS DOUBLE)"
        out["rail_trace_guardrail"] = f"CAST(CASE WHEN subcategory IN ('infrastructure_landmark', 'trail_river_access') AND NOT {RAIL_ANCHOR} AND coalesce(rail_basis = 'rule' AND rail_links = 0, false) THEN -3 ELSE 0 END AS DOUBLE)"
    return out


BONUS = "CAST(CASE match_type WHEN 'primary' THEN 10 WHEN 'secondary' THEN 2.5 ELSE 0 END AS DOUBLE)"


def guardrail(fit: str, high: float, low: float) -> str:
    return f"CAST(CASE WHEN match_type <> 'secondary' THEN 0 WHEN {fit} >= {high} THEN 0 WHEN {fit} >= {low} THEN -1 ELSE -2 END AS DOUBLE)"


def scored(rows: str, spatial: dict[str, str], parts: dict[str, str], guard: str) -> str:
    """rows with all components by name and their exact sum."""
    every = {k: r(v, 2) for k, v in spatial.items()} | parts | {"category_bonus": BONUS, "category_intent_guardrail": guard}
    listed = ", ".join(f"{v} AS {k}" for k, v in every.items())
    summed = " + ".join(f"CAST({k} AS DECIMAL(12,2))" for k in every)
    return f"SELECT *, {r(f'CAST({summed} AS DOUBLE)', 1)} AS score FROM (SELECT *, {listed} FROM ({rows}) AS a) AS b"
