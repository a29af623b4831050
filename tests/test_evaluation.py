"""Routes of a table against one route at a time; cases, suites and the files of a run; a place's detail; weights."""

import json

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from cairn.engine import Engine
from cairn.functions import vocab
from cairn.operators import evaluation, requests, scoring
from cairn.plans import views
from cairn.sources import readers

LINE = ((-106.05, 35.63), (-105.98, 35.66), (-105.94, 35.69), (-105.88, 35.73))
BENT = tuple((-105.95 + 0.002 * (i % 7), 35.65 + 0.001 * i) for i in range(60))
ASKED = [
    scoring.Route(LINE, 3000, 10, "civic", limit=20), scoring.Route(BENT, 900, 5, "history", "walking", limit=10), scoring.Route(((-105.94, 35.68), (-105.94, 35.68)), 4000, 30, "art", "walking"), scoring.Route(LINE, 6000, 30, "mixed", theme="rail", limit=20),
    scoring.Route(((-120.0, 30.0), (-90.0, 40.0)), 40000, 200, "scenic"), scoring.Route(LINE, 500, 1, "food", "walking"), scoring.Route(LINE, 5000, 20, "culture", city="region2"), scoring.Route(((10.0, 0.0), (10.1, 0.0)), 500, 5),
]
SCHEMA = "request_id int, line array<struct<lon: double, lat: double>>, max_detour_m int, max_extra_min int, category string, mode string, theme string, city string, limit int"


@pytest.fixture(scope="module")
def places(spark, sf_dir):
    rail = (F.col("poi_id") % 3 == 0).cast("boolean")
    rows = views.places(spark, sf_dir).withColumns({"themes": F.when(rail, F.array(F.lit("rail"))).otherwise(F.array().cast("array<string>")), "theme_status": F.when(rail, "accepted"), "rail_basis": F.lit("rule"), "rail_links": F.lit(0)})
    return rows.persist()


def test_each_route_equals_its_own_plan(spark, places):
    bad = [(90, [(0.0, 0.0)], 5, 5, "mixed", "driving", None, None, 5), (91, [(0.0, 0.0), (None, 1.0)], 5, 5, "mixed", "driving", None, None, 5), (92, [(0.0, 0.0), (1.0, 1.0)], 0, 5, "mixed", "driving", None, None, 5), (93, None, 5, 5, "mixed", "driving", None, None, 5)]
    table = spark.createDataFrame([(i, list(q.line), q.max_detour_m, q.max_extra_min, q.category, q.mode, q.theme, q.city, q.limit) for i, q in enumerate(ASKED)] + bad, SCHEMA)
    found = requests.routes(places, table).persist()
    columns = ["poi_id", "distance_m", "detour_m", "extra_min", "match_type", "route_proximity", "detour_fit", "budget_fit", "mode_affinity", "rail_anchor_bonus", "rail_trace_guardrail", "civic_anchor_bonus", "category_intent_guardrail", "score"]
    some = 0
    for i, q in enumerate(ASKED):
        want = [tuple(r) for r in scoring.best(scoring.score_route(places, q), q.limit).select(*columns).collect()]
        assert [tuple(r) for r in found.where(f"request_id = {i}").orderBy("rank").select(*columns).collect()] == want
        some += len(want)
    assert some > 30 and found.where("request_id >= 90").count() == 0
    assert requests.routes(places, table.where("false")).count() == 0
    # A route of 3,000 km takes cells along it, not the box around it.
    cover = requests._covered(table.where("request_id = 4"))
    assert cover.count() < 20000 and cover.select(F.max(F.size("segments"))).first()[0] == 1


def test_weights(spark, places):
    q = scoring.Nearby(-105.9378, 35.687, 4000, limit=20)
    none = dict.fromkeys(vocab.WEIGHTS, 0.0)
    rows = Engine(places, none).nearby(q).collect()
    assert rows and all(r.significance == r.quality == r.mode_affinity == r.official_corroboration == r.penalties == 0 for r in rows)
    own = Engine(places, vocab.WEIGHTS).nearby(q).select("poi_id", "score").collect()
    assert own == Engine(places).nearby(q).select("poi_id", "score").collect() and own[0].score > 0
    asked = spark.createDataFrame([(1, q.lon, q.lat, q.radius_m, q.category, q.mode, None, None, q.limit)], "request_id int, lon double, lat double, radius_m int, category string, mode string, theme string, city string, limit int")
    assert [r.poi_id for r in Engine(places, none).nearby_all(asked).orderBy("rank").collect()] == [r.poi_id for r in rows]
    with pytest.raises(ValueError):
        Engine(places, {"charm": 1.0}).nearby(q)


def _case(name, kind="nearby", **expectations):
    where = {"center": {"lat": 35.687, "lon": -105.9378}, "radius_meters": 6000} if kind == "nearby" else {"route_geometry": {"type": "LineString", "coordinates": [list(p) for p in LINE]}, "max_detour_meters": 3000, "max_extra_minutes": 10}
    return {"id": name, "label": name, "purpose": "test", "mode": kind, "category": "mixed", "travel_mode": "walking" if kind == "nearby" else "driving", "expectations": expectations} | where


def test_cases_of_both_kinds_and_a_run(spark, places, tmp_path):
    near = [r.name for r in Engine(places).nearby(scoring.Nearby(-105.9378, 35.687, 6000, limit=5)).collect()]
    along = [r.name for r in Engine(places).route(scoring.Route(LINE, 3000, 10)).collect()]
    assert len(near) == len(along) == 5 and len(set(near)) == 5
    cases = [
        _case("good", expected_any_names=[near[4], "nowhere"], preferred_top_names=near[:2], required_preferred_top_names_count=2, min_results=5, max_results=5),
        _case("late", preferred_top_names=[near[4]], required_preferred_top_names_count=1),
        _case("several", expected_any_names=["nowhere"], forbidden_names=[near[0], "nowhere", near[1]], min_results=6),
        _case("too few", preferred_top_names=[near[0], "nowhere"], required_preferred_top_names_count=2),
        _case("filled", expected_empty=True, max_results=0),
        _case("far", expected_empty=True) | {"center": {"lat": 0.0, "lon": 10.0}},
        _case("far and expected", expected_any_names=["x"]) | {"center": {"lat": 0.0, "lon": 10.0}},
        _case("route good", "route", expected_any_names=[along[2]], min_results=1),
        _case("route bad", "route", forbidden_names=[along[0]]) | {"limit": 1},
        _case("wrong", expected_empty=True) | {"category": "charm"},
    ]
    (tmp_path / "cases.json").write_text(json.dumps({"cases": cases}))
    read = readers.evaluation_cases(spark, str(tmp_path / "cases.json")).persist()
    got = {r.case_id: r for r in evaluation.evaluated(places, read).collect()}
    assert {k: r.passed for k, r in got.items()} == {"good": True, "late": True, "several": False, "too few": False, "filled": False, "far": True, "far and expected": False, "route good": True, "route bad": False, "wrong": False}
    assert got["good"].names == near and got["good"].matched == [near[4]] and got["good"].warnings == [] and got["route good"].names == along
    assert got["late"].warnings == ["no preferred name in the first three"] and got["wrong"].notes == ["can't be asked"]
    assert sorted(got["several"].notes) == sorted([f"forbidden: {near[0]}", f"forbidden: {near[1]}", "none of the expected names", "number of results"]) and got["several"].violated == near[:2]
    assert got["filled"].notes == ["expected nothing", "number of results"] and got["far and expected"].notes == ["no results", "none of the expected names"]
    assert got["too few"].notes == ["too few of the preferred names"] and got["route bad"].results == 1

    out = tmp_path / "run"
    assert evaluation.write_run(places, read, str(out), ["all-fixtures"], each=True) == {"all-fixtures": {"passed": 4, "failed": 6}}
    held = json.loads((out / "all-fixtures.json").read_text())
    assert held["passed"] == 4 and [c["case_id"] for c in held["cases"]] == sorted(c["id"] for c in cases)
    assert (out / "index.md").read_text().endswith("4 of 10 passed\n") and len(list((out / "all-fixtures").iterdir())) == 20
    assert "## FAIL route bad" in (out / "all-fixtures.md").read_text() and f"1. {near[0]} (" in (out / "all-fixtures" / "good.md").read_text()
    stem = evaluation.write_review(str(out / "reviews"), "2024-01-02T03:04:05Z", "someone", "fine", got["too few"].asDict(), "keep")
    assert stem.endswith("2024-01-02T03-04-05Z-too-few") and json.loads(open(stem + ".json").read())["names"] == near
    with pytest.raises(KeyError, match="nearby-plaza-history"):
        evaluation.suite_members(read, ["core-product"])
    with pytest.raises(KeyError, match="no such suites: x"):
        evaluation.suite_members(read, ["x"])
    with pytest.raises(KeyError, match="a, b"):
        evaluation.chosen(read, ["a", "good", "b"])
    assert [r.case_id for r in evaluation.chosen(read, ["late", "good", "late"]).orderBy("at").collect()] == ["late", "good"]


def test_named_suites(spark, places):
    ids = sorted({c for names in vocab.SUITES.values() for c in names})
    assert len(ids) == 14
    cases = spark.createDataFrame([(c,) for c in ids], "case_id string")
    members = evaluation.suite_members(cases)
    found = cases.select("case_id", (F.col("case_id") != "route-acequia-water").alias("passed"), F.array().cast("array<string>").alias("warnings"))
    got = {r.suite: (r.run, r.passed, r.all_passed) for r in evaluation.by_suite(found, members).collect()}
    assert got == {"core-product": (6, 6, True), "rail-smoke": (4, 4, True), "water-smoke": (3, 2, False), "empty-result-guardrails": (4, 4, True), "nearby-smoke": (8, 8, True), "route-smoke": (6, 5, False), "all-fixtures": (14, 13, False)}


def test_route_fixtures(spark, places, tmp_path):
    asked = {"route_geometry": {"type": "LineString", "coordinates": [list(p) for p in LINE]}, "travel_mode": "driving", "category": "civic", "max_detour_meters": 3000, "max_extra_minutes": 10}
    (tmp_path / "f.json").write_text(json.dumps({"fixtures": [{"name": "a", "description": "", "request": asked}, {"name": "b", "description": "", "request": asked, "expected_non_empty": False}, {"name": "c", "description": "", "request": asked, "expected_any_names": ["none such"]}]}))
    got = {r.case_id: r for r in evaluation.evaluated(places, readers.route_fixtures(spark, str(tmp_path / "f.json"))).collect()}
    assert {k: r.passed for k, r in got.items()} == {"a": True, "b": False, "c": False} and got["a"].results == 5


def test_detail_of_one_place(spark):
    at = {"lon": 1.0, "lat": 2.0, "tags": {}, "normalized_subcategory": "infrastructure_landmark", "is_active": True, "editorial_status": None, "official": None}
    frame = spark.createDataFrame([Row(poi_id=1, canonical_name="A", normalized_category="civic", display=["civic", "history"], **at), Row(poi_id=2, canonical_name="B", normalized_category="food", display=["food"], **at)],
        "poi_id int, canonical_name string, normalized_category string, display array<string>, lon double, lat double, tags map<string,string>, normalized_subcategory string, is_active boolean, editorial_status string, official double")
    evidence = spark.createDataFrame([(1, "s2", "a", "x", None, None, 0.5), (1, "s1", "b", None, None, None, 0.5), (1, "s1", "b", "l", "t", None, 0.5), (1, "s1", "a", "z", None, "u", None), (2, "s1", "a", "z", None, None, 1.0)], "poi_id int, source_id string, evidence_type string, label string, text string, url string, confidence double")
    raw = spark.createDataFrame([(1,), (1,), (3,)], "poi_id int")
    themes = spark.createDataFrame([], "poi_id int, themes array<struct<theme: string>>")
    (r,) = Engine(frame).detail(1, evidence, raw, themes).collect()
    assert (r.name, r.primary_category, r.secondary_categories, r.themes, r.provenance.raw_source_count, r.provenance.osm_id) == ("A", "civic", ["history"], [], 2, None)
    assert [(e.source_id, e.evidence_type, e.label) for e in r.evidence] == [("s1", "a", "z"), ("s1", "b", None), ("s1", "b", "l"), ("s2", "a", "x")]
    assert r.why_it_matters == ["historical significance signal present", "reveals civic or infrastructural traces"] and r.badges == ["history", "infrastructure trace"]
    assert r.short_description == vocab.TYPES["infrastructure_landmark"][1]
    (r,) = Engine(frame.withColumns({"normalized_subcategory": F.lit(None).cast("string"), "official": F.lit(0.7), "editorial_status": F.lit("featured")})).detail(2, evidence, raw, themes).collect()
    assert r.short_description == vocab.NO_DESCRIPTION and r.why_it_matters == ["corroborated by official city or heritage sources"] and r.badges == ["featured", "officially corroborated"]
    assert Engine(frame).detail(9, evidence, raw, themes).count() == 0
