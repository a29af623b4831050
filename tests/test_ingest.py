"""Ingest runs, refreshes, their counters, enrichment by latest tags, and the queue of theme reviews."""

import itertools
import tempfile

import pytest
from pyspark.sql import functions as F

from cairn.operators import details, ingest, runs, themes
from cairn.sources.metrics import Counters, event_line


def rows(spark, schema, *data):
    return spark.createDataFrame(list(data), schema)


def elements(spark, *data):
    return rows(spark, ingest._ELEMENT, *(("node", i, 35.6 + i / 1000, -105.9, tags, None, None, None) for i, tags in data))


MUSEUM, VIEW = {"name": "Old Mill", "tourism": "museum"}, {"name": "Acequia View", "tourism": "viewpoint", "waterway": "ditch"}


def day(d):
    return F.to_timestamp(F.lit(f"2024-01-0{d} 00:00:00"))


@pytest.fixture(scope="module")
def store(spark):
    return runs.Store(spark, f"file://{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}/store")


def test_two_runs_and_a_refresh(spark, store):
    first = ingest.run(store, "survey", "town", day(1), elements(spark, (1, MUSEUM), (2, VIEW), (3, {"tourism": "museum"}), (4, {"name": "Nothing"}), (2, VIEW)))
    assert {k: v for k, v in first.items() if k != "run"} == {"version": 1, "raw_inserted": 4, "raw_updated": 0, "skipped": 2, "canonical_inserted": 2, "canonical_updated": 0}
    before = {r.record_id: r for r in store.read()["poi"].collect()}
    assert {k: (r.canonical_name, r.normalized_subcategory, r.review_status, r.is_active) for k, r in before.items()} == {
        "node/1": ("Old Mill", "museum", "needs_review", True), "node/2": ("Acequia View", "overlook_vista", "needs_review", True),
    }
    # A reviewer's word stays, a changed record changes its place, a record of another region isn't touched by this one.
    reviewed = store.read()["poi"].withColumn("review_status", F.lit("approved"))
    store.commit({"poi": reviewed}, 1)
    second = ingest.run(store, "survey", "town", day(2), elements(spark, (1, MUSEUM | {"name": "New Mill"}), (2, VIEW), (5, MUSEUM)))
    assert {k: v for k, v in second.items() if k != "run"} == {"version": 3, "raw_inserted": 2, "raw_updated": 1, "skipped": 2, "canonical_inserted": 1, "canonical_updated": 2}
    t = store.read()
    after = {r.record_id: r for r in t["poi"].collect()}
    assert {k: (r.canonical_name, r.review_status) for k, r in after.items()} == {"node/1": ("New Mill", "approved"), "node/2": ("Acequia View", "approved"), "node/5": ("Old Mill", "needs_review")}
    assert {k: r.poi_id for k, r in before.items()}.items() <= {k: r.poi_id for k, r in after.items()}.items()
    counts = {r.poi_id: r.source_count for r in t["signals"].collect()}
    assert {k: counts[r.poi_id] for k, r in after.items()} == {"node/1": 2, "node/2": 1, "node/5": 1}
    assert t["raw"].where("is_current").count() == 5 and t["raw"].count() == 6 and t["editorial"].count() == 3
    stamps = {(r.theme, r.computed_at.day) for r in t["memberships"].collect()}
    assert stamps == {("water", 1)}  # unchanged since the first run

    third = ingest.run(store, "survey", "town", day(3))
    assert {k: v for k, v in third.items() if k != "run"} == {"version": 4, "skipped": 2, "canonical_inserted": 0, "canonical_updated": 3}
    assert ingest.run(store, "survey", "elsewhere", day(4))["canonical_updated"] == 0
    assert {r.state for r in store.runs().collect()} == {"completed"}


def test_empty_batch_and_failure(spark, store):
    base = store.version()
    found = ingest.run(store, "survey", "town", day(4), elements(spark).where("false"))
    assert (found["raw_inserted"], found["raw_updated"], found["canonical_updated"]) == (0, 0, 3)
    with pytest.raises(Exception):
        ingest.run(store, "survey", "town", day(4), elements(spark, (9, MUSEUM)).withColumn("lat", F.raise_error(F.lit("broken"))))
    assert store.version() == base + 1 and store.runs().where("state = 'failed'").count() == 1


def test_counters_need_no_job_of_their_own(spark):
    sc, out = spark.sparkContext, iter(range(9))
    df = spark.range(1000).repartition(4)

    def jobs(frame):
        sc.setJobGroup(group := f"counters-{next(out)}", "")
        frame.write.format("noop").mode("overwrite").save()
        return len(sc.statusTracker().getJobIdsForGroup(group))

    counters = Counters()
    plain = jobs(df)
    assert jobs(counters.on(df, even=F.col("id") % 2 == 0, none=F.lit(None).cast("boolean"))) == plain
    assert counters.values() == {"even": 500, "none": 0}
    sc.setJobGroup("", "")


def test_event_line():
    assert event_line("run", b=2, a=None, c="x") == "event=run b=2 c=x"


def test_merge_in_steps_is_a_replay(spark):
    """Batches merged one after the other against a replay in plain Python."""
    schema = "source_name string, record_id string, content_hash string, fetched_at int"
    batches = [{"a": "1", "b": "1", None: "1"}, {"a": "1", "b": "2"}, {"b": "1", "c": None}, {"a": "2", "b": "1", "c": None}]
    stored = rows(spark, schema + ", is_current boolean")
    want = []
    for at, batch in enumerate(batches):
        stored = ingest.merged_raw(stored, rows(spark, schema, *(("s", k, h, at) for k, h in batch.items()))).drop("action")
        for k, h in batch.items():
            live = next((w for w in want if w[0] == k and w[3] and k is not None), None)
            if live and live[1] == h:
                live[2] = at
            else:
                if live:
                    live[3] = False
                want.append([k, h, at, True])
    got = [[r.record_id, r.content_hash, r.fetched_at, r.is_current] for r in stored.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_latest_tags_and_hints(spark):
    raw = rows(spark, "poi_id long, fetched_at int, record_id string, is_current boolean, tags map<string,string>", (1, 1, "a", True, {"wikidata": "Q1"}), (1, 2, "a", False, {"wikidata": "Q2"}), (1, 1, "b", True, {"wikidata": " Q3", "wikipedia": "en:A b", "x": None}), (2, 1, "c", True, None), (None, 9, "d", True, {"wikidata": "Q9"}))
    tags = ingest.latest_tags(raw)
    assert {r.poi_id: r.tags for r in tags.collect()} == {1: {"wikidata": " Q3", "wikipedia": "en:A b"}, 2: {}}
    places = rows(spark, "poi_id long, wikidata_id string", (1, "Q7"), (2, "Q8"), (3, None))
    assert {r.poi_id: (r.wikidata_id, r.title_hint) for r in details.with_hints(places, tags).collect()} == {1: ("Q3", "A_b"), 2: ("Q8", None), 3: (None, None)}


def test_repeated_entities_keep_places_single(spark):
    places = rows(spark, "poi_id long, wikidata_id string, wikipedia_title string, title_hint string, short_description string, normalized_subcategory string, entity_type_confidence double, description_quality double, has_wikidata boolean, has_wikipedia boolean", (1, "Q1", None, None, None, "museum", 0.5, 0.0, False, False), (2, None, None, None, None, "museum", 0.5, 0.0, False, False))
    entities = rows(spark, "entity_id string, description string, title string", ("Q1", "a mill", "Mill"), ("Q1", "a mill", "Mill"), ("Q1", None, None))
    out = {r.poi_id: r for r in details.enriched(places, entities).collect()}
    assert len(out) == 2 and (out[1].wikipedia_title, out[1].has_wikidata, out[1].has_wikipedia, out[1].short_description) == ("Mill", True, True, "a mill")
    assert (out[2].outcome, out[2].has_wikidata) == ("skipped", False)
    counts = details.enrichment_counts(details.enriched(places, entities), entities.select("entity_id")).first()
    assert tuple(counts) == (2, 1, 1, 1)
    assert tuple(details.enrichment_counts(details.enriched(places.where("false"), entities), entities.where("false")).first()) == (0, 0, 0, 0)


def test_theme_queue_filters(spark):
    """Every combination of filters against a filter in plain Python."""
    keys = [(p, t) for p in range(1, 7) for t in ("water", "rail")]
    members = {k: ("accepted" if k[0] % 2 else "candidate", 0.5 + k[0] / 100, k[0]) for k in keys if k[0] != 3}
    decided = {k: ("force_exclude" if k[0] % 3 else "none", k[0] if k[0] % 4 else 99) for k in keys if k[1] == "rail" and k[0] > 1}
    m = rows(spark, "poi_id long, theme string, status string, basis string, confidence double, computed_at int", *((*k, s, "rule", c, at) for k, (s, c, at) in members.items()))
    d = rows(spark, "poi_id long, theme string, decision string, reviewed_at int, stamp int", *((*k, x, 1, stamp) for k, (x, stamp) in decided.items()))
    p = rows(spark, "poi_id long, canonical_name string, city string, category string", *((i, f"Name {9 - i}", "x" if i < 5 else "y", "art") for i in range(1, 7)))
    links = rows(spark, "poi_id long, theme string, evidence_id long", (1, "water", 1), (1, "water", 1), (1, "water", 2), (3, "rail", 5))

    def state(k):
        return "unreviewed" if k not in decided else "reviewed" if k not in members or decided[k][1] == members[k][2] else "stale"

    every = sorted((k for k in keys if k in members or k in decided), key=lambda k: (("unreviewed", "stale", "reviewed").index(state(k)), ("candidate", "accepted", None).index(members.get(k, (None,))[0]), members[k][1] if k in members else 1.0, f"name {9 - k[0]}", k))
    for theme, city, status, review, decision in itertools.product((None, "rail"), (None, "x"), (None, "accepted"), (None, "stale"), (None, "none")):
        want = [k for k in every if theme in (None, k[1]) and (city is None or k[0] < 5) and status in (None, members.get(k, (None,))[0]) and review in (None, state(k)) and decision in (None, decided.get(k, (None,))[0])]
        if sum(x is not None for x in (theme, city, status, review, decision)) in (0, 1, 5) or (status and decision):
            got = {(r.poi_id, r.theme) for r in themes.queue(m, d, p, links, theme, city, status, review, decision).collect()}
            assert got == set(want), (theme, city, status, review, decision)
    short = {(r.poi_id, r.theme): r for r in themes.queue(m, d, p, links, limit=3).collect()}
    assert set(short) == set(every[:3])
    full = {(r.poi_id, r.theme): r for r in themes.queue(m, d, p, links).collect()}
    assert full[1, "water"].evidence_count == 2 and full[3, "rail"].evidence_count == 0 and full[2, "rail"].effective_status == "suppressed"
