"""The library behind one object: suggestions, details, review queues, evaluation cases."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators import details, evaluation, explain, requests, scoring
from cairn.operators.scoring import Nearby, Route


def _flags(rows: DataFrame) -> DataFrame:
    made = {k: F.array_contains("display", v) for k, v in (("historical", "history"), ("cultural", "culture"), ("scenic", "scenic"))}
    made |= {"infrastructure": F.col("normalized_subcategory") == "infrastructure_landmark", "has_wikidata": F.map_contains_key("tags", F.lit("wikidata"))}
    return rows.withColumns({k: v for k, v in made.items() if k not in rows.columns})


@dataclass(frozen=True)
class Engine:
    """places: a place frame with signals and editorial columns (see operators.scoring)."""

    places: DataFrame
    #: Weights of the score that differ from vocab.WEIGHTS.
    weights: Mapping[str, float] | None = None

    def _explained(self, top: DataFrame, mode: str, travel: str, theme: str | None) -> DataFrame:
        """Titles, reasons and badges, for the rows left after the limit."""
        rows = _flags(top)
        return rows.withColumns({"name": F.coalesce(F.nullif("title", F.lit("")), "canonical_name"), "why": explain.reasons(mode, theme), "badges": explain.badges(mode, travel, theme)})

    def nearby(self, req: Nearby) -> DataFrame:
        return self._explained(scoring.best(scoring.score_nearby(self.places, req, self.weights), req.limit), "nearby", req.mode, req.theme)

    def route(self, req: Route) -> DataFrame:
        return self._explained(scoring.best(scoring.score_route(self.places, req, self.weights), req.limit), "route", req.mode, req.theme)

    def nearby_all(self, asked: DataFrame) -> DataFrame:
        """The best places of every request of a table (see requests.nearby)."""
        return requests.nearby(self.places, asked, self.weights)

    def routes_all(self, asked: DataFrame) -> DataFrame:
        """The best places of every route of a table (see requests.routes)."""
        return requests.routes(self.places, asked, self.weights)

    def evaluated(self, cases: DataFrame) -> DataFrame:
        """What every evaluation case fails (see evaluation.evaluated)."""
        return evaluation.evaluated(self.places, cases, self.weights)

    def detail(self, poi_id: int, evidence: DataFrame, raw: DataFrame, themes: DataFrame) -> DataFrame:
        """All that is known of one place (see details.place_detail); no row if it isn't there."""
        one = lambda rows: rows.where(F.col("poi_id") == poi_id)
        return details.place_detail(_flags(one(self.places)), one(evidence), one(raw), one(themes))

    def queue(self, status: str, default: str = "pending") -> DataFrame:
        shown = F.coalesce("editorial_status", F.lit(default))
        return self.places.where(shown == status)


def case_result(names: list[str], expected: tuple[str, ...] = (), forbidden: tuple[str, ...] = (), preferred: tuple[str, ...] = (), required_preferred: int | None = None, least: int | None = None, most: int | None = None, expect_empty: bool = False) -> list[str]:
    """What an evaluation case's result, by rank, fails; an empty list if it passes. As requests.outcomes, for one case."""
    n, misses = len(names), [f"forbidden: {x}" for x in forbidden if x in names]
    if expect_empty and n:
        misses.append("expected nothing")
    if not expect_empty and not n:
        misses.append("no results")
    if expected and not set(expected) & set(names):
        misses.append("none of the expected names")
    if least is not None and n < least or most is not None and n > most:
        misses.append("number of results")
    if required_preferred is not None and sum(x in names for x in preferred) < required_preferred:
        misses.append("too few of the preferred names")
    return misses
