"""Elements, classification, geometry, ranking, themes, matching, snapshots on small inputs of our own."""

import hashlib
import io
import json
import math
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from cairn.engine import case_result
from cairn.functions import geo, text
from cairn.functions.rounding import py_round
from cairn.operators import classify, details, editorial, evidence, matching, scoring, snapshots, themes
from cairn.sources import readers, writers


def rows(spark, schema, *values):
    return spark.createDataFrame(list(values), schema)


def test_rounding_is_by_exact_value(spark):
    values = [33.25, 33.35, 33.15, 2.675, -0.0, 0.05, 1e6 + 0.15]
    df = rows(spark, "x double", *[(v,) for v in values])
    for places in (1, 2):
        assert [r[0] for r in df.select(py_round(F.col("x"), places)).collect()] == [round(v, places) + 0.0 for v in values]


@pytest.fixture(scope="module")
def elements(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("in") / "elements.json"
    square = [(0.0, 0.0), (0.0, 2.0), (2.0, 2.0), (2.0, 0.0), (0.0, 0.0)]
    ring = lambda pts: [{"lon": x, "lat": y} for x, y in pts]
    items = [
        {"type": "way", "id": 1, "geometry": ring(square), "tags": {"name": "Old Park Plaza", "leisure": "park"}},
        {"type": "node", "id": 2, "lat": 35.0, "lon": -105.0, "tags": {"name": "Viewpoint", "tourism": "viewpoint", "historic": "memorial"}},
        {"type": "node", "id": 3, "lat": 35.0, "lon": -105.0, "tags": {"tourism": "museum"}},
        {"type": "node", "id": 4, "lat": 35.0, "lon": -105.0, "tags": {"name": "Shop", "shop": "yes"}},
        {"type": "way", "id": 5, "geometry": ring([(0, 0), (4, 0)]), "tags": {"name": "Acequia Mural", "tourism": "artwork", "artwork_type": "mural"}},
        {"type": "way", "id": 6, "center": {"lat": 1.0, "lon": 2.0}, "tags": {"name": "Canal", "man_made": "canal", "wikidata": "Q1"}},
        {"type": "relation", "id": 7, "bounds": {"minlat": 0, "minlon": 0, "maxlat": 2, "maxlon": 4}, "tags": {"name": "Bosque", "natural": "wood"}},
        {"type": "way", "id": 8, "geometry": ring([(1, 1), (1, 1), (1, 1), (1, 1)]), "tags": {"name": "Dot", "historic": "yes"}},
    ]
    path.write_text(json.dumps({"version": 0.6, "elements": items}))
    return {r.id: r for r in classify.audited(readers.elements(spark, str(path))).collect()}


def test_first_matching_rule_and_status(elements):
    assert [elements[i].status for i in range(1, 9)] == ["classified", "classified", "skipped_missing_name", "skipped_unclassified"] + ["classified"] * 4
    assert elements[1].rule == "park_named_plaza" and elements[1].display == ["civic"]
    assert elements[2].kind == "overlook_vista" and elements[2].display == ["scenic", "history"]
    assert elements[5].rule == "acequia_named_artwork_override" and elements[5].display == ["civic", "art"]
    assert (elements[6].base_significance, elements[6].quality_score) == (68.0, 62.5)


def test_element_geometry(elements):
    at = {i: (elements[i].lon, elements[i].lat) for i in (1, 2, 5, 6, 7, 8)}
    assert at == {1: (1.0, 1.0), 2: (-105.0, 35.0), 5: (2.0, 0.0), 6: (2.0, 1.0), 7: (2.0, 1.0), 8: (1.0, 1.0)}


def test_element_query_has_each_kind_and_filter():
    made = readers.element_query((1, 2, 3, 4))
    assert made.count("(1,2,3,4);") == 3 * len(readers.ELEMENT_FILTERS) and 'node["historic"](1,2,3,4);' in made


def test_ring_holds_its_edges_and_corners(spark):
    ring = [{"x": 0.0, "y": 0.0}, {"x": 4.0, "y": 0.0}, {"x": 4.0, "y": 4.0}, {"x": 2.0, "y": 2.0}, {"x": 0.0, "y": 4.0}, {"x": 0.0, "y": 0.0}]
    polygons = rows(spark, "polygon_id int, ring array<struct<x: double, y: double>>", (1, ring))
    points = [(1, 1.0, 1.0), (2, 0.0, 0.0), (3, 4.0, 3.0), (4, 2.0, 3.0), (5, 5.0, 1.0), (6, 3.0, 3.0), (7, 2.0, 0.0)]
    places = rows(spark, "poi_id int, x double, y double", *points)
    assert {r.poi_id for r in matching.contained(places, polygons, 1.0).collect()} == {1, 2, 3, 6, 7}


def test_grid_join_equals_all_pairs(spark):
    pts = [(i, -105.9 + (i * 37 % 100) / 20000, 35.6 + (i * 53 % 100) / 20000) for i in range(60)]
    f = rows(spark, "feature_id int, lon double, lat double", *pts[::2])
    p = rows(spark, "poi_id int, lon double, lat double", *pts[1::2])
    want = {(a[0], b[0]) for a in pts[::2] for b in pts[1::2] if math.hypot(a[1] - b[1], a[2] - b[2]) * matching.METRES_PER_DEGREE <= 150}
    got = [(r.feature_id, r.poi_id) for r in matching.within_distance(f, p, 150.0).collect()]
    assert set(got) == want and len(got) == len(want)


def place(poi_id, lon, lat, name="House", category="history", kind="historic_site", display=("history",), tags=None, **more):
    x, y = geo.project(lon, lat)
    return {"poi_id": poi_id, "canonical_name": name, "x": x, "y": y, "normalized_category": category, "normalized_subcategory": kind, "display": list(display), "tags": tags or {}, "is_active": True, "city": "a", "base_significance": 70.0, "quality_score": 60.0, "walk_affinity": 0.55, "drive_affinity": 0.9, "official": None, "district": None, "institutional": None, "genericity": None, "boost": None, "title": None, "editorial_status": None} | more


PLACE = "poi_id int, canonical_name string, x double, y double, normalized_category string, normalized_subcategory string, display array<string>, tags map<string,string>, is_active boolean, city string, base_significance double, quality_score double, walk_affinity double, drive_affinity double, official double, district double, institutional double, genericity double, boost double, title string, editorial_status string"


def test_nearby_ranks_and_breaks_ties_by_id(spark):
    at = (-105.938, 35.687)
    frame = spark.createDataFrame([place(3, *at), place(2, *at), place(4, *at, category="civic", kind="civic_space_plaza", display=("civic", "history")), place(5, -106.25, 35.687), place(6, *at, is_active=False), place(7, *at, name="Palace of the Governors")], PLACE)
    found = scoring.best(scoring.score_nearby(frame, scoring.Nearby(*at, 800, "history")), 10).collect()
    assert [r.poi_id for r in found] == [7, 2, 3, 4]
    assert found[1].score == round(18 + 12 + 21.0 + 6.0 + 4.4 + 10, 1) and found[0].score == found[1].score + 6
    assert found[3].match_type == "secondary" and found[3].category_intent_guardrail == 0.0


def test_route_budget_is_there_and_back(spark):
    line = ((-105.95, 35.687), (-105.93, 35.687))
    north = lambda m: 35.687 + m / 137_000
    frame = spark.createDataFrame([place(1, -105.94, north(100)), place(2, -105.94, north(300)), place(3, -105.94, north(600))], PLACE)
    found = scoring.along_route(frame, scoring.Route(line, 700, 20)).collect()
    assert [r.poi_id for r in found] == [1, 2] and all(r.detour_m == 2 * r.distance_m for r in found)


def test_requests_are_checked():
    for bad in (dict(radius_m=0), dict(radius_m=5, limit=21), dict(radius_m=5, category="x"), dict(radius_m=5, theme="public_memory"), dict(radius_m=5, mode="fly")):
        with pytest.raises(ValueError):
            scoring.Nearby(0, 0, **bad)
    with pytest.raises(ValueError):
        scoring.Route(((0, 0),), 5, 5)


def test_evidence_is_capped_and_districts_add(spark):
    ev = rows(spark, "poi_id int, evidence_type string, property_category string", (1, "historic_designation", "district"), (1, "boundary_membership", None), (2, "institution_membership", None), (3, "unknown", None))
    found = {r.poi_id: (r.official, r.district, r.institutional, r.heritage) for r in evidence.rollup(ev).collect()}
    assert found == {1: (1.0, 1.0, 0.0, True), 2: (0.3, 0.0, 0.75, False), 3: (0.0, 0.0, 0.0, False)}


def test_themes_by_rule_name_and_evidence(spark):
    made = [
        place(1, 0, 0, "Acequia Madre", "civic", "infrastructure_landmark", ("civic",), {"man_made": "canal"}) | {"aliases": [], "water_ids": [], "rail_ids": []},
        place(2, 0, 0, "River Trail", "scenic", "trail_river_access", ("scenic",), {"waterway": "river"}) | {"aliases": [], "water_ids": [5], "rail_ids": []},
        place(3, 0, 0, "Acequia Cafe", "food", "market_food_identity", ("food",)) | {"aliases": [], "water_ids": [1], "rail_ids": []},
        place(4, 0, 0, "Depot", "history", "historic_site", ("history",)) | {"aliases": ["Railway Depot"], "water_ids": [], "rail_ids": []},
    ]
    frame = spark.createDataFrame(made, PLACE + ", aliases array<string>, water_ids array<bigint>, rail_ids array<bigint>")
    found = {(r.poi_id, r.theme): (r.confidence, r.basis, r.status) for r in themes.evaluated(frame).collect()}
    assert found == {(1, "water"): (0.95, "rule", "accepted"), (2, "water"): (0.85, "mixed", "accepted"), (4, "rail"): (0.7, "rule", "accepted")}


def test_editorial_decisions_hold(spark):
    m = rows(spark, "poi_id int, theme string, status string, basis string, confidence double", (1, "water", "accepted", "rule", 0.7), (2, "water", "accepted", "rule", 0.7))
    d = rows(spark, "poi_id int, theme string, decision string", (1, "water", "force_exclude"), (2, "water", "force_include"), (3, "rail", "force_include"), (4, "rail", "force_exclude"))
    got = {r.poi_id: (r.effective_status, r.effective_confidence, r.effective_basis) for r in themes.effective(m, d).collect()}
    assert got == {1: ("suppressed", 0.7, "rule"), 2: ("accepted", 0.9, "mixed"), 3: ("accepted", 1.0, "editorial"), 4: ("suppressed", 0.0, "editorial")}


def test_snapshots_close_and_open(spark):
    t = lambda d: datetime(2024, 1, d)
    snap = rows(spark, "source_name string, record_id string, fetched_at timestamp, seq int, content_hash string", ("s", "a", t(1), 1, "x"), ("s", "a", t(2), 2, "x"), ("s", "a", t(3), 3, "y"), ("s", "a", t(4), 4, "x"))
    got = [(r.seq, r.version, r.is_current) for r in snapshots.versions(snap).orderBy("seq").collect()]
    assert got == [(1, 1, False), (3, 2, False), (4, 3, True)] and snapshots.current(snap).first().seq == 4
    stored = rows(spark, "source_name string, record_id string, content_hash string, fetched_at timestamp, is_current boolean", ("s", "a", "x", t(1), True), ("s", "b", "x", t(1), True), ("s", "c", "x", t(1), True), ("s", "b", "w", t(1), False))
    batch = rows(spark, "source_name string, record_id string, content_hash string, fetched_at timestamp", ("s", "a", "x", t(2)), ("s", "b", "z", t(2)), ("s", "d", "z", t(2)))
    after = snapshots.merged(stored, batch)
    assert sorted((r.record_id, r.action, r.is_current) for r in after.collect()) == [("a", "touched", True), ("b", "changed", True), ("b", "closed", False), ("b", "history", False), ("c", "absent", True), ("d", "new", True)]


def test_streamed_merge_keeps_one_current_row(spark, tmp_path):
    from cairn.streaming.snapshots import merge_stream

    schema = "source_name string, record_id string, content_hash string, fetched_at timestamp"
    for n, hash_ in enumerate(("x", "y")):
        rows(spark, schema, ("s", "a", hash_, datetime(2024, 1, 1 + n))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    merge_stream(spark, stream, str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination(120)
    last = spark.read.parquet(str(tmp_path / "out/pointers")).orderBy(F.col("number").desc()).first().path
    assert spark.read.parquet(last).where("is_current").count() == 1


def test_register_names(spark):
    names = ["Governor’s House & Casa", "St. Miguel Churches", "The Old National Register District", "Ñandú œuvre ﬁn", "  "]
    df = rows(spark, "n string", *[(n,) for n in names])
    strict = [r[0] for r in df.select(text.historic_name(text.decomposed_ascii(F.regexp_replace("n", "’", "'")))).collect()]
    assert strict[:3] == ["governor house house", "saint miguel chapel", "old national register district"]
    assert [r[0] for r in df.select(text.slug(F.col("n"))).collect()][3:] == ["nandu-uvre-fin", "poi"]
    assert df.select(text.historic_name(F.col("n"), relaxed=True)).collect()[2][0] == "old"


def test_upserts_aliases_and_reset(spark):
    stored = rows(spark, "k int, a string, b string", (1, "x", "y"), (2, "x", None))
    got = {r.k: (r.a, r.b, r.action) for r in editorial.upserted(stored, rows(spark, "k int, a string, b string", (1, None, "n"), (3, "q", "r")), "k", keep=("b",)).collect()}
    assert got == {1: ("x", "y", "updated"), 2: ("x", None, "kept"), 3: ("q", "r", "inserted")}
    tables = {"poi": rows(spark, "poi_id int, city string", (1, "a"), (2, "b")), "child": rows(spark, "poi_id int", (1,), (2,), (2,))}
    assert {n: t.count() for n, t in editorial.without_region(tables, "b").items()} == {"poi": 1, "child": 1}


def _workbook(headers, *lines):
    cell = lambda i, v: f'<c r="{chr(65 + i)}1" t="inlineStr"><is><t>{v}</t></is></c>'
    body = "".join("<row>" + "".join(cell(i, v) for i, v in enumerate(line)) + "</row>" for line in (headers, *lines))
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="List" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


def test_workbook_register(spark, tmp_path):
    (tmp_path / "r.xlsx").write_bytes(_workbook(["Name", "STATE\nREGISTER", "Town"], ["Mill", "1971", "Santa Fé"], ["", "1972", "x"], ["", "", ""]))
    made = readers.workbook_rows(spark, str(tmp_path / "r.xlsx"))
    got = readers.state_register(readers.best_sheet(made, [["name"], ["town"]])).collect()
    assert [(r.property_name, r.state_register_year, r.city, r.state) for r in got] == [("Mill", "1971", "santa-fe", "NEW MEXICO")]


def test_national_register_and_entities(spark, tmp_path):
    (tmp_path / "n.csv").write_text("﻿Ref#,Property Name,State,City \n1,Mill,NM,Santa Fe\n2,,NM,x\n", encoding="utf-8")
    got = readers.national_register(spark, str(tmp_path / "n.csv")).collect()
    assert [(r.reference_number, r.property_name, r.city) for r in got] == [("1", "Mill", "santa-fe")]
    (tmp_path / "e.json").write_text(json.dumps({"entities": {"Q1": {"labels": {"de": {"value": "Haus"}}, "descriptions": {"en": {"value": "d"}}, "sitelinks": {"enwiki": {"title": "A b"}}}}}))
    e = readers.entities(spark, str(tmp_path / "e.json")).first()
    assert (e.label, e.description, e.title) == ("Haus", "d", "A_b")


def test_layer_features(spark, tmp_path):
    doc = {"features": [{"id": 0, "geometry": {"type": "Point", "coordinates": [1.0, 2.0]}, "properties": {"OBJECTID": 7, "NAME": "A"}}, {"id": 1, "geometry": None, "properties": {}}, {"id": 2, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}, "properties": {}}]}
    (tmp_path / "f.json").write_text(json.dumps(doc))
    found = readers.features(spark, str(tmp_path / "f.json"), "NAME", "Layer")
    p = readers.point_features(found).first()
    assert (p.feature_id, p.label, p.lon, p.lat) == ("7", "A", 1.0, 2.0)
    g = readers.polygon_features(found).first()
    assert g.label == "Layer" and len(g.ring) == 4


def test_writers(spark, tmp_path):
    df = rows(spark, "a string, b array<string>, c map<string,string>", ("x", ["p", "q"], {"k": "v"}))
    writers.write_audit(df, str(tmp_path / "csv"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first().b == "p|q"
    assert "| x |" in writers.report("T", df.select("a"))


def test_cases():
    assert case_result(["a", "b"], expected=("b",), preferred=("a",), least=1) == []
    assert case_result([], expected=("b",)) == ["no results", "none of the expected names"] and case_result([], expect_empty=True) == []
    assert case_result(["a"], forbidden=("a",)) == ["forbidden: a"]


def test_reviews_keep_their_preconditions(spark):
    d = rows(spark, "id int, status string, resolved_poi int", (1, "unmatched", None), (2, "resolved", 5), (3, "resolved", 5), (4, "unreviewed", None))
    n = rows(spark, "id int, new_status string, new_poi int", (1, "suppressed", None), (2, "resolved", 5), (3, "resolved", 6))
    got = {r.id: (r.outcome, r.status, r.resolved_poi) for r in editorial.reviewed_diagnostics(d, n).collect()}
    assert got == {1: ("applied", "suppressed", None), 2: ("applied", "resolved", 5), 3: ("refused", "resolved", 5), 4: ("untouched", "unreviewed", None)}


def test_memberships_merge_and_go_stale(spark):
    s = rows(spark, "poi_id int, theme string, status string, basis string, confidence double, rationale string, computed_at int", (1, "water", "accepted", "rule", 0.7, "r", 1), (2, "water", "accepted", "rule", 0.7, "r", 1), (3, "water", "accepted", "rule", 0.7, "r", 1))
    f = rows(spark, "poi_id int, theme string, status string, basis string, confidence double, rationale string", (1, "water", "accepted", "rule", 0.7, "r"), (2, "water", "accepted", "mixed", 0.8, "r"), (4, "rail", "accepted", "rule", 0.7, "r"))
    assert {r.poi_id: r.action for r in themes.merged(s, f).collect()} == {1: "keep", 2: "update", 3: "delete", 4: "insert"}
    states = rows(spark, "at int, member boolean, stamp int, computed int", (None, True, 1, 1), (1, False, None, None), (1, True, 1, 1), (1, True, None, 1), (1, True, 1, 2))
    assert [r[0] for r in states.select(themes.review_state(F.col("at"), F.col("member"), F.col("stamp"), F.col("computed"))).collect()] == ["unreviewed", "reviewed", "reviewed", "stale", "stale"]


def test_layers_become_evidence(spark):
    from cairn.operators import layers

    places = rows(spark, "poi_id int, canonical_name string, category string, lon double, lat double, x double, y double", (1, "History Museum", "history", -105.94, 35.69, -105.94, 35.69), (2, "Cafe", "food", -105.941, 35.69, -105.941, 35.69))
    features = rows(spark, "feature_id string, label string, lon double, lat double", ("9", "History Museums", -105.94001, 35.69))
    found = layers.from_points(features, places.drop("x", "y"), "city_gis_museums").collect()
    assert [(r.poi_id, r.evidence_type, r.evidence_key) for r in found] == [(1, "institution_membership", "city-gis-museums-9-1")]
    ring = [{"x": -105.9405, "y": 35.68}, {"x": -105.93, "y": 35.68}, {"x": -105.93, "y": 35.70}, {"x": -105.9405, "y": 35.70}, {"x": -105.9405, "y": 35.68}]
    polygons = rows(spark, "feature_id string, label string, ring array<struct<x: double, y: double>>", ("3", "Plaza Park", ring))
    inside = layers.from_polygons(polygons, places.select("poi_id", "x", "y"), "city_gis_plaza_park").collect()
    assert [(r.poi_id, r.confidence) for r in inside] == [(1, 0.85)]
    assert layers.seeds(spark).count() == 11


def test_every_alias_is_held_against_every_owner(spark):
    owned = rows(spark, "poi_id int, normalized_alias string", (1, "mill"), (3, "mill"), (3, "mill"), (7, "mill"), (4, "depot"))
    wanted = rows(spark, "poi_id int, normalized_alias string", (1, "mill"), (3, "mill"), (9, "mill"), (4, "depot"), (5, "depot"), (6, "plaza"))
    got = {(r.poi_id, r.normalized_alias, r.owner, r.others) for r in editorial.first_conflicts(wanted, owned).collect()}
    assert got == {(1, "mill", 3, 2), (3, "mill", 1, 2), (9, "mill", 1, 3), (5, "depot", 4, 1)}


def test_holes_and_multipolygons(spark):
    from cairn.operators import layers

    square = lambda x, y, n: f"[[{x},{y}],[{x + n},{y}],[{x + n},{y + n}],[{x},{y + n}],[{x},{y}]]"
    found = rows(spark, "feature_id string, label string, kind string, coordinates string", ("a", "A", "Polygon", f"[{square(0, 0, 4)},{square(1, 1, 2)}]"), ("b", "B", "MultiPolygon", f"[[{square(10, 0, 2)}],[{square(12, 0, 2)},{square(12.5, 0.5, 1)}]]"), ("c", "C", "Point", "[1,1]"))
    places = rows(spark, "poi_id int, x double, y double", (1, 0.5, 0.5), (2, 2.0, 2.0), (3, 1.0, 2.0), (4, 11.0, 1.0), (5, 13.0, 1.0), (6, 12.0, 1.0))
    inside = layers.from_polygons(readers.polygon_features(found), places, "city_gis_plaza_park", 1.0).collect()
    assert sorted((r.label, r.poi_id) for r in inside) == [("A", 1), ("A", 3), ("B", 4), ("B", 6)]


def test_names_with_marks_meet(spark):
    row = spark.createDataFrame([("Peña Café", "Pena Cafe")], "a string, b string")
    same = row.select(text.name_words(F.col("a")) == text.name_words(F.col("b")), text.historic_name(F.col("a")) == text.historic_name(F.col("b"))).first()
    assert same == (True, True)


def test_details(spark):
    seen = spark.createDataFrame([(1, "historic_building_status", "Fort", " Listed ", "", '{"match_strategy": "alias_exact"}'), (2, "historic_building_status", "Fort", " ", None, '{"match_strategy": 3}'), (3, "other", "River", "x", "y", "{}")], "id int, kind string, label string, status string, district string, payload string")
    rows = seen.select("id", details.evidence_text(F.col("kind"), F.col("label"), F.col("status"), F.col("district"), "the layer"), details.match_method(F.col("payload")), details.case_slug("case", F.col("status"))).orderBy("id").collect()
    assert [tuple(r)[1:] for r in rows] == [("Listed", "alias_exact", "case-listed"), ("Fort via the layer", None, "case"), ("River via the layer", None, "case-x")]
    maps = spark.createDataFrame([({"b": "2", "a": "é"},), ({},)], "tags map<string,string>").select(details.payload_hash(F.col("tags"))).collect()
    assert [r[0] for r in maps] == [hashlib.sha256(t.encode()).hexdigest() for t in ('{"a":"é","b":"2"}', "{}")]
    chunks = details.chunked(spark.range(200), "id", 40, 3).collect()
    assert sorted(v for c in chunks for v in c["values"]) == list(range(200)) and max(len(c["values"]) for c in chunks) <= 40
    top = details.ranked(spark.createDataFrame([(3, 1.0), (1, 2.0), (2, 1.0)], "poi_id int, score double")).orderBy("rank").collect()
    assert [(r.rank, r.poi_id) for r in top] == [(1, 1), (2, 2), (3, 3)]
