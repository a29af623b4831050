"""Register matching against a brute-force version, register runs, and what reviewers see."""

from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from cairn.functions import text
from cairn.operators import registers
from cairn.plans import queries


def rows(spark, schema, *data):
    return spark.createDataFrame(list(data), schema)


def brute(spark, reg, places, aliases, threshold):
    """Every row against every place in order, by plain Python over forms and words."""
    names = [r[0] for r in reg.select(F.explode("names").alias("n")).unionByName(places.select(F.col("canonical_name").alias("n"))).unionByName(aliases.select(F.col("alias_name").alias("n"))).distinct().collect()]
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", text.historic_forms(F.col("n")).alias("f"))
    forms = {r.n: r.f or [] for r in df.collect()}
    flat = spark.createDataFrame([(f,) for f in {f for fs in forms.values() for f in fs}], "f string").select("f", text.name_words(F.col("f")).alias("w"))
    words = {r.f: set(r.w) for r in flat.collect()}

    def like(a, b):
        if set(forms[a]) & set(forms[b]):
            return 1.0
        best = 0.0
        for f in forms[a]:
            for g in forms[b]:
                x, y = words[f], words[g]
                if x and y:
                    best = max(best, len(x & y) / len(x | y), SequenceMatcher(None, " ".join(sorted(x)), " ".join(sorted(y))).ratio())
        return best

    held = sorted((p.poi_id, p.canonical_name, bool(p.is_historical)) for p in places.collect())
    more = {}
    for a in aliases.collect():
        more.setdefault(a.poi_id, []).append(a.alias_name)
    out = {}
    for r in reg.collect():
        best = None
        mine = {f for n in r.names for f in forms[n]}
        for poi_id, name, historical in held:
            others = [name, *sorted(more.get(poi_id, []))]
            exact = next((n for n in others if mine & set(forms[n])), None)
            if exact is not None:
                best = (poi_id, exact, "canonical_exact" if exact == name else "alias_exact", 1.0, 0.99)
                break
            found, called = 0.0, name
            for n in r.names:
                for o in others:
                    if like(n, o) > found:
                        found, called = like(n, o), o
            confidence = min(round(found + 0.05 * historical, 4), 0.99)
            if best is None or confidence > best[4]:
                best = (poi_id, called, "fuzzy_fallback", found, confidence)
        out[r.row_id] = (*best, best[3] >= threshold)
    return out


def test_matches_equal_brute_force(spark):
    stems = ["Adobe Mill", "Barrio Chapel", "Cistern", "San Miguel Church", "Old Governors Residence", "The Museum", "Rail Yard Depot", "Pump Station Seven", "Saint Michael Mission", "Acequia Madre House"]
    places = rows(spark, "poi_id int, canonical_name string, is_historical boolean", *[(i, f"{stems[i % 10]} {'' if i % 3 else i // 10} {'Works' if i % 4 == 0 else ''}", [True, False, None][i % 3]) for i in range(1, 60)])
    aliases = rows(spark, "poi_id int, alias_name string", (4, "Pump Staton Seven B"), (2, "Zzyzx Oratory"), (2, "Aardvark Hall"), (31, "Nothing in common"), (9, "Misión San Miguel"))
    reg = rows(
        spark, "row_id int, names array<string>", (1, ["Nothing Alike", "Pump Station Sevens"]), (2, ["Zzyzx Oratori"]), (3, ["The Barrio Chapel"]), (4, ["Adobe Mill Worx", "Aardvark Halls"]), (5, ["The"]), (6, ["Adobe Mill Worx"]),
        (7, ["qqq"]), (8, [""]), (9, ["Governor's Home, Old & new"]), (10, ["Church St. Miguel 5"]), (11, ["House of the Acequia"]), (12, ["depot rail yards"]), (13, ["a"]), (15, ["Zzyzx Oratory"]), (14, ["Mision Saint Michel", "Chapel"]),
        *[(20 + i, [f"{stems[i % 10][::-1]} {stems[(i * 3) % 10]}"]) for i in range(30)],
    )
    got = {r.row_id: (r.poi_id, r.matched_name, r.method, r.likeness, r.confidence, r.accepted) for r in registers.matches(reg, places, aliases, 0.78).collect()}
    assert got == brute(spark, reg, places, aliases, 0.78)
    assert {m for _, _, m, _, _, _ in got.values()} == {"canonical_exact", "alias_exact", "fuzzy_fallback"} and got[4][0] is not None
    assert registers.matches(reg, places.where("false"), aliases.where("false"), 0.78).count() == 0
    assert registers.matches(reg.where("false"), places, aliases, 0.78).count() == 0


def test_whole_tables_equal_brute_force_with_few_comparisons(spark, sf_dir):
    found = queries.QUERIES["fuzzy_name_match"](spark, sf_dir)
    reg, places, aliases = queries.fuzzy_inputs(spark, sf_dir)
    got = {r.row_id: r for r in found.collect()}
    want = brute(spark, reg, places, aliases, 0.78)
    assert {k: (r.poi_id, r.matched_name, r.method, r.likeness, r.confidence, r.accepted) for k, r in got.items()} == want
    assert not any("Cartesian" in p or "NestedLoop" in p for p in [found._jdf.queryExecution().toString()])


def test_comparisons_are_few(spark):
    """Names of which most can't be the best are ruled out by their lengths and letters."""
    import random

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvwy") for _ in range(rng.randint(4, 9)))
    names = [f"{word()} {word()} {word()}" for _ in range(3000)]
    places = rows(spark, "poi_id int, canonical_name string, is_historical boolean", *[(i, n, False) for i, n in enumerate(names)])
    reg = rows(spark, "row_id int, names array<string>", *[(i, [names[i * 29].replace("a", "e", 1) + "x"]) for i in range(100)])
    found = registers.matches(reg, places, places.where("false").select("poi_id", F.col("canonical_name").alias("alias_name")), 0.78)
    assert found.agg(F.sum("compared")).first()[0] < 100 * 3000 / 20
    assert found.where("poi_id = row_id * 29").count() == 100


@pytest.fixture(scope="module")
def run(spark):
    reg = rows(spark, "row_id int, reference_number string, property_name string", (1, "N1", "Adobe Mill"), (2, "", "Barrio Chapel"), (3, "N3", "Qqqq"), (4, None, "Far Place"))
    places = rows(spark, "poi_id int, canonical_name string, city string, is_historical boolean", (1, "Adobe Mill", "a", True), (2, "Barrio Chapels", "a", False), (3, "Far Place", "b", False))
    evidence = rows(spark, "evidence_key string, poi_id int, source_id string, evidence_type string, label string, text string, record_id string, confidence double", *[(f"k{i}{s}", i, s, "x", "", "", "r", 1.0) for i in (1, 2, 3) for s in ("nrhp", "gis")])
    diagnostics = rows(spark, "source_id string, region string, record_id string, external_name string, matched_poi_id int, best_name string, best_similarity double, match_strategy string, status string", *[(s, c, "r", "old", None, None, None, None, "suppressed") for s in ("nrhp", "gis") for c in ("a", "b")])
    found = registers.matches(reg.select("row_id", F.array("property_name").alias("names")), places.where("city = 'a'"), places.where("false").select("poi_id", F.col("canonical_name").alias("alias_name")), 0.78)
    return registers.run(reg, found, evidence, diagnostics, places, "nrhp", "a", "historic_designation", F.concat(F.lit("Listed: "), "property_name"))


def test_a_run_replaces_its_own_evidence(run):
    got = {(r.evidence_key, r.poi_id, r.source_id) for r in run["evidence"].collect()}
    assert got == {("k1gis", 1, "gis"), ("k2gis", 2, "gis"), ("k3gis", 3, "gis"), ("k3nrhp", 3, "nrhp"), ("1-nrhp-n1", 1, "nrhp"), ("2-nrhp-barrio-chapel", 2, "nrhp")}
    assert {r.poi_id for r in run["touched"].collect()} == {1, 2}
    assert run["counts"].first().asDict() == {"candidate_rows": 4, "evidence_created": 2, "unmatched_rows": 2, "impacted_places": 2}


def test_a_run_leaves_diagnostics(run):
    got = run["diagnostics"].collect()
    assert {(r.source_id, r.region) for r in got if r.external_name == "old"} == {("nrhp", "b"), ("gis", "a"), ("gis", "b")}
    new = {r.external_name: r for r in got if r.external_name != "old"}
    assert set(new) == {"Qqqq", "Far Place"} and new["Far Place"].record_id == "Far Place" and new["Qqqq"].record_id == "N3"
    assert all(r.status == "unreviewed" and r.match_strategy == "fuzzy_fallback" and r.best_name for r in new.values())


def test_why_rows_were_not_linked(spark):
    d = rows(
        spark, "id int, source_id string, region string, external_name string, status string, matched_poi_id int, best_name string, resolved_poi_id int, best_similarity double, match_strategy string, resolution_method string",
        (1, "n", "a", "The Mill", "unmatched", None, None, None, None, None, None), (2, "n", "a", "x", "resolved", 1, "old", 2, 0.5, None, "manual_alias"), (3, "n", "a", "x", "suppressed", 1, "old", None, 0.5, None, None),
        (4, "n", "b", "x", "unreviewed", 9, "gone", None, 0.4567, None, None), (5, "m", "a", "x", "resolved", None, "old", None, 0.5, None, None),
    )
    sources = rows(spark, "source_id string, source_name string, source_type string", ("n", "National", "register"))
    places = rows(spark, "poi_id int, canonical_name string", (1, "One"), (2, "Two"))
    got = {r.id: r for r in registers.diagnostic_items(d, sources, places, "all").collect()}
    assert [got[i].why_not_linked for i in range(1, 6)] == [
        "No plausible canonical POI candidate was found.", "Resolved manually to 'Two' via manual_alias.", "Suppressed during editorial review.",
        "Best candidate 'gone' via fuzzy_fallback scored 0.457, below the auto-link threshold.", "Resolved manually to 'old' via manual review.",
    ]
    assert (got[2].best_name, got[4].best_name, got[5].source_name, got[1].normalized_name) == ("One", "gone", None, "mill")
    assert {r.id for r in registers.diagnostic_items(d, sources, places, "unreviewed", "a").collect()} == {1}
    assert {r.id for r in registers.diagnostic_items(d, sources, places, "resolved", source_id="m").collect()} == {5}
