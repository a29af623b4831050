"""Runs, commits and command logs."""

import itertools

import pytest
from pyspark.sql import functions as F

from cairn.functions import text
from cairn.operators import commands, evidence, runs, themes
from cairn.plans import queries, views


def rows(spark, schema, *data):
    return spark.createDataFrame(list(data), schema)


@pytest.fixture(scope="module")
def layer(spark, sf_dir):
    stored, fresh, region = queries.layer_inputs(spark, sf_dir)
    after, touched = runs.replaced(stored, fresh, region)
    return stored, fresh, after.persist(), touched.persist()


def test_touched_places_only(layer):
    stored, fresh, after, touched = layer
    keyed = lambda df: {(r.poi_id, r.evidence_id, r.evidence_type) for r in df.collect()}
    differ = {p for p, _, _ in keyed(stored) ^ keyed(after)}
    assert {r.poi_id for r in touched.collect()} == differ and differ
    assert keyed(after) == {k for k in keyed(stored) if k[1] % 10 != 1 or k[0] % 5 == 2} | keyed(fresh)


def test_signals_equal_a_full_sum(spark, layer):
    stored, _, after, touched = layer
    before = evidence.rollup(stored).withColumn("computed_at", F.lit(1))
    got = {r.poi_id: r for r in runs.signals_after(before, after, touched, F.lit(2)).collect()}
    full = {r.poi_id: tuple(r[1:]) for r in evidence.rollup(after).collect()}
    old = {r.poi_id: tuple(r[1:-1]) for r in before.collect()}
    none = (0.0, 0.0, 0.0, False)
    assert set(got) == set(old) | set(full)
    for poi_id, r in got.items():
        assert tuple(r[1:-1]) == full.get(poi_id, none)
        assert r.computed_at == (1 if old.get(poi_id) == tuple(r[1:-1]) else 2)
    assert {r.computed_at for r in got.values()} == {1, 2}


def test_memberships_equal_a_full_evaluation(spark, sf_dir, layer):
    stored, _, after, touched = layer
    places = views.places(spark, sf_dir, signals=False).withColumn("aliases", F.array().cast("array<string>"))

    def full(ev):
        ids = themes.theme_evidence(ev)
        none = F.array().cast("array<bigint>")
        return themes.evaluated(places.join(ids, "poi_id", "left").withColumns({c: F.coalesce(c, none) for c in ("water_ids", "rail_ids")}))

    columns = ["poi_id", "theme", "status", "basis", "confidence", "rationale", "evidence_ids"]
    before = full(stored).select(*columns).withColumn("computed_at", F.lit(1))
    memory = rows(spark, before.schema, (1, "public_memory", "accepted", "rule", 0.7, "", [], 1))
    got = runs.memberships_after(before.unionByName(memory), places, after, touched, F.lit(2)).collect()
    want = {tuple(map(str, r)) for r in full(after).select(*columns).collect()} | {("1", "public_memory", "accepted", "rule", "0.7", "", "[]")}
    assert {tuple(map(str, r[:-1])) for r in got} == want and len(got) == len(want)
    old = {(r.poi_id, r.theme): tuple(r[2:6]) for r in before.collect()}
    assert all(r.computed_at == (1 if old.get((r.poi_id, r.theme), tuple(r[2:6])) == tuple(r[2:6]) else 2) for r in got)


def test_a_row_that_repeats_and_goes_once_touches(spark):
    schema = "poi_id int, source_id string, evidence_id int"
    after, touched = runs.replaced(rows(spark, schema, (1, "a", 1), (1, "a", 1), (2, "a", 2), (3, "b", 3)), rows(spark, schema, (1, "a", 1), (2, "a", 2)), rows(spark, "poi_id int", (1,), (2,)))
    assert [r.poi_id for r in touched.collect()] == [1] and after.count() == 3


@pytest.fixture
def store(spark, tmp_path):
    return runs.Store(spark, f"file://{tmp_path}/store")


def test_of_two_commits_one_wins(spark, store):
    a = rows(spark, "k int, v string", (1, "x"))
    assert store.version() == 0 and store.read() == {}
    assert store.commit({"t": a, "u": a}, 0) == 1
    first, second = store.version(), store.version()
    assert store.commit({"t": rows(spark, "k int, v string", (2, "first"))}, first) == 2
    with pytest.raises(runs.Conflict):
        store.commit({"t": rows(spark, "k int, v string", (3, "second"))}, second)
    assert [tuple(r) for r in store.read()["t"].collect()] == [(2, "first")] and store.read()["u"].count() == 1
    assert [tuple(r) for r in store.read(1)["t"].collect()] == [(1, "x")]


def test_two_writers_past_the_check(spark, store):
    """Both have seen the old version; only one can claim the next."""
    store.commit({"t": rows(spark, "k int", (1,))}, 0)
    other = runs.Store(spark, store.path)
    other.version = lambda: 1
    assert store.commit({"t": rows(spark, "k int", (2,))}, 1) == 2
    with pytest.raises(runs.Conflict):
        other._publish(1, {"t": "tables/none"})
    assert [r.k for r in store.read()["t"].collect()] == [2]


def test_rules_keep_the_old_version(spark, store):
    poi = rows(spark, "poi_id int", (1,), (2,))
    keys, parents = {"poi": ["poi_id"]}, [("child", ["poi_id"], "poi", ["poi_id"])]
    child = lambda *ids: rows(spark, "poi_id int", *[(i,) for i in ids])
    store.commit({"poi": poi, "child": child(1, None)}, 0, keys, parents)
    for bad in ({"poi": child(1, 1, 2)}, {"poi": child(1, None)}, {"child": child(3)}, {"poi": child(2)}):
        with pytest.raises(runs.Conflict):
            store.commit(bad, 1, keys, parents)
    assert store.version() == 1 and store.read()["poi"].count() == 2


def test_the_run_log(spark, store):
    runs.recorded(store, "ingest", lambda tables: {"t": rows(spark, "k int", (1,))})
    with pytest.raises(runs.Conflict):
        runs.recorded(store, "layer", lambda tables: {"t": tables["t"].unionByName(tables["t"])}, keys={"t": ["k"]})
    with pytest.raises(ZeroDivisionError):
        runs.recorded(store, "layer", lambda tables: 1 / 0)
    got = sorted((r.run.split("-")[0], r.state) for r in store.runs().collect())
    assert got == [("ingest", "completed"), ("layer", "failed"), ("layer", "failed")] and store.version() == 1


def replay(diagnostics, log, places, aliases, normalize):
    """One command after another, by plain Python."""
    state = {d.id: [d.status, d.resolved_poi] for d in diagnostics}
    owners, taken, out, made = {}, {}, {}, set()
    for a in aliases:
        owners.setdefault(a.normalized_alias, set()).add(a.poi_id)
    name = {d.id: d.external_name for d in diagnostics}
    for c in sorted(log, key=lambda c: c.seq):
        if c.id not in state or c.action != "suppress" and c.poi_id not in places:
            out[c.seq] = "refused"
            continue
        want = ["suppressed", None] if c.action == "suppress" else ["resolved", c.poi_id]
        ok = state[c.id][0] in ("unreviewed", "unmatched") or state[c.id] == want
        alias = normalize[c.alias_name or name[c.id]] if c.action == "alias" else None
        if alias is not None:
            first = taken.setdefault(alias, c.poi_id)
            ok = ok and (owners[alias] == {c.poi_id} if alias in owners else first == c.poi_id)
        out[c.seq] = "applied" if ok else "refused"
        if ok:
            state[c.id] = want
            if alias is not None and c.poi_id not in owners.get(alias, ()):
                made.add((c.poi_id, alias))
    return state, out, made


def test_log_equals_a_replay(spark, sf_dir):
    diagnostics, log, places, aliases = queries.log_inputs(spark, sf_dir)
    extra = rows(spark, "id long, external_name string, status string, resolved_poi long", (10**6, "Mill", "unreviewed", None))
    clicks = [("alias", 1, None), ("alias", 2, None), ("suppress", None, None), ("alias", 1, None), ("resolve", 1, None), ("resolve", 10**7, None)]
    more = rows(spark, "seq long, id long, action string, poi_id long, alias_name string, reviewed_by string", *[(10**7 + i, 10**6, a, p, n, "me") for i, (a, p, n) in enumerate(clicks)], (10**8, 10**9, "resolve", 1, None, "me"))
    diagnostics, log = diagnostics.unionByName(extra), log.unionByName(more)
    names = {r[0] for r in diagnostics.select("external_name").unionByName(log.select(F.col("alias_name").alias("external_name"))).distinct().collect()} - {None}
    normalize = {r.n: r.h for r in spark.createDataFrame([(n,) for n in names], "n string").select("n", text.historic_name(F.col("n")).alias("h")).collect()}
    state, out, made = replay(diagnostics.collect(), log.collect(), {r.poi_id for r in places.collect()}, aliases.collect(), normalize)
    done = commands.folded(diagnostics, log, places, aliases)
    assert {r.id: [r.status, r.resolved_poi] for r in done["diagnostics"].collect()} == state
    assert {r.seq: r.outcome for r in done["outcomes"].collect()} == out and set(out.values()) == {"applied", "refused"}
    assert {(r.poi_id, r.normalized_alias) for r in done["aliases"].collect()} == made
    assert {r.id for r in done["links"].collect()} == {c.id for c in log.collect() if out[c.seq] == "applied" and c.action != "suppress"}
