"""Evaluation cases near points and along routes, all in one plan: what each fails, suites of cases, and the files of a run."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Mapping
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions import vocab
from cairn.operators import requests

_SHARED = ("category", "mode", "theme", "city", "limit")
_CHECKS = ("expect_empty", "expected", "forbidden", "preferred", "required_preferred", "least", "most")
#: A run's files hold at most so many cases; a run of more says so. Results of more cases stay DataFrames.
MOST_CASES = 2000


def ranked(places: DataFrame, cases: DataFrame, weights: Mapping[str, float] | None = None) -> DataFrame:
    """request_id, rank, name, category, match_type, score of every result of every case (see evaluated)."""
    ask = lambda kind, *own: cases.where(F.col("kind") == kind).select(F.col("case_id").alias("request_id"), *own, *_SHARED)
    places = requests.prepared(places, weights)
    near = requests.nearby(places, ask("nearby", "lon", "lat", "radius_m"), weights)
    along = requests.routes(places, ask("route", "line", "max_detour_m", "max_extra_min"), weights)
    shown = ("request_id", "rank", F.coalesce(F.nullif("title", F.lit("")), "canonical_name").alias("name"), F.col("normalized_category").alias("category"), "match_type", "score")
    return near.select(*shown).unionByName(along.select(*shown))


def evaluated(places: DataFrame, cases: DataFrame, weights: Mapping[str, float] | None = None) -> DataFrame:
    """case_id, passed, results, notes, warnings, matched, violated and names of every case.

    places: as requests.nearby takes them. cases: case_id (unique), kind (nearby or route), the columns of a request of either kind (those of the other are null) and what requests.outcomes expects. A
    case that can't be asked fails, with a note that says so. No cases give no rows."""
    asked = F.when(F.col("kind") == "nearby", requests.valid(cases)).when(F.col("kind") == "route", requests.valid_route(cases)).otherwise(F.lit(False))
    rows = cases.select("case_id", F.col("case_id").alias("request_id"), F.lit(None).cast("string").alias("suite"), *_CHECKS)
    found = requests.outcomes(rows, ranked(places, cases, weights)).drop("suite")
    wrong = cases.where(~F.coalesce(asked, F.lit(False))).select("case_id", F.lit(True).alias("wrong"))
    found = found.join(wrong, "case_id", "left").withColumn("wrong", F.coalesce("wrong", F.lit(False)))
    notes = F.when(F.col("wrong"), F.array(F.lit("can't be asked"))).otherwise(F.col("notes"))
    return found.withColumns({"passed": F.col("passed") & ~F.col("wrong"), "notes": notes}).drop("wrong")


def chosen(cases: DataFrame, case_ids: Iterable[str]) -> DataFrame:
    """The cases named, each with its place among the names (at); an error lists those that aren't there. The names are a person's, so they fit the driver."""
    wanted = list(dict.fromkeys(case_ids))
    asked = cases.sparkSession.createDataFrame([(n, i) for i, n in enumerate(wanted)], "case_id string, at int")
    missing = [r["case_id"] for r in asked.join(cases.select("case_id"), "case_id", "left_anti").orderBy("at").collect()]
    if missing:
        raise KeyError(f"no such cases: {', '.join(missing)}")
    return cases.join(F.broadcast(asked), "case_id")


def suite_members(cases: DataFrame, suites: Iterable[str] = tuple(vocab.SUITES)) -> DataFrame:
    """case_id, suite, at: the cases of each suite; a suite without names holds all cases, ordered by case_id. An error tells of unknown suites and of cases that aren't there."""
    suites = list(suites)
    if unknown := [s for s in suites if s not in vocab.SUITES]:
        raise KeyError(f"no such suites: {', '.join(unknown)}")
    schema = "case_id string, suite string, at int"
    named = [(c, s, i) for s in suites for i, c in enumerate(vocab.SUITES[s])]
    out = cases.sparkSession.createDataFrame(named, schema)
    chosen(cases, [c for c, _, _ in named])
    for s in suites:
        if not vocab.SUITES[s]:
            out = out.unionByName(cases.select("case_id", F.lit(s).alias("suite"), F.lit(0).alias("at")))
    return out


def by_suite(found: DataFrame, members: DataFrame) -> DataFrame:
    """suite, run, passed, failed, warned and all_passed. found: see evaluated; members: case_id, suite."""
    rows = members.join(found, "case_id")
    return rows.groupBy("suite").agg(F.count(F.lit(1)).alias("run"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"), F.count_if(F.size("warnings") > 0).alias("warned"), F.bool_and("passed").alias("all_passed"))


def markdown(title: str, rows: list[dict]) -> str:
    """Cases with their outcome, what was expected, and their results."""
    passed = sum(r["passed"] for r in rows)
    lines = [f"# {title}", "", f"- Cases: {len(rows)}", f"- Passed: {passed}", f"- Failed: {len(rows) - passed}", ""]
    for r in rows:
        lines += [f"## {'PASS' if r['passed'] else 'FAIL'} {r['case_id']}", f"- Results: {r['results']}"]
        lines += [f"- {k}: {', '.join(r[c])}" for k, c in (("Expected and found", "matched"), ("Forbidden and found", "violated")) if r[c]]
        lines += [f"- Warning: {w}" for w in r["warnings"]] + [f"- Note: {n}" for n in r["notes"]]
        lines += [f"{x['rank']}. {x['name']} ({x['category']}), match {x['match_type']}, score {x['score']:.1f}" for x in r["found"]] + [""]
    return "\n".join(lines)


def file_name(name: str) -> str:
    return re.sub(r"[^A-Za-z0-9._-]+", "-", name).strip("-.") or "case"


def write_run(places: DataFrame, cases: DataFrame, folder: str, suites: Iterable[str] = tuple(vocab.SUITES), each: bool = False, weights: Mapping[str, float] | None = None) -> dict[str, dict]:
    """Evaluates the cases of all suites once, in one plan, and writes for each suite its JSON and Markdown (each: for each case too) and index.md. Returns passed and failed by suite.

    Reports are for people: at most MOST_CASES cases reach the driver, an error says if there are more."""
    suites = list(suites)
    members = suite_members(cases, suites)
    places_in = members.orderBy("at", "case_id").limit(20 * MOST_CASES).collect()
    ids = {r["case_id"] for r in places_in}
    if len(ids) > MOST_CASES:
        raise ValueError(f"a report holds at most {MOST_CASES} cases; use evaluated() and by_suite()")
    mine = cases.join(members.select("case_id").distinct(), "case_id", "left_semi")
    results = ranked(places, mine, weights).groupBy(F.col("request_id").alias("case_id")).agg(F.array_sort(F.collect_list(F.struct("rank", "name", "category", "match_type", "score"))).alias("found"))
    rows = {r["case_id"]: r.asDict(recursive=True) for r in evaluated(places, mine, weights).join(results, "case_id", "left").collect()}
    for r in rows.values():
        r["found"] = r["found"] or []
    root, index, out = Path(folder), ["# Suites", ""], {}
    root.mkdir(parents=True, exist_ok=True)

    def write(stem: Path, title: str, part: list[dict]) -> None:
        good = sum(r["passed"] for r in part)
        stem.with_name(stem.name + ".json").write_text(json.dumps({"passed": good, "failed": len(part) - good, "cases": part}, indent=2, sort_keys=True, ensure_ascii=False) + "\n", encoding="utf-8")
        stem.with_name(stem.name + ".md").write_text(markdown(title, part), encoding="utf-8")

    for s in suites:
        part = [rows[r["case_id"]] for r in places_in if r["suite"] == s]
        good = sum(r["passed"] for r in part)
        out[s] = {"passed": good, "failed": len(part) - good}
        write(root / file_name(s), s, part)
        index.append(f"- [{s}]({file_name(s)}.md): {good} of {len(part)} passed")
        if each:
            (root / file_name(s)).mkdir(exist_ok=True)
            for r in part:
                write(root / file_name(s) / file_name(r["case_id"]), r["case_id"], [r])
    (root / "index.md").write_text("\n".join(index) + "\n", encoding="utf-8")
    return out


def write_review(folder: str, at: str, reviewer: str, verdict: str, case: dict, note: str | None = None) -> str:
    """A person's verdict on one case (a row of evaluated as a dict) as JSON and Markdown; gives the path without its ending. at: the time, in the file's name, so that reviews stand side by side."""
    stem = Path(folder) / f"{file_name(at)}-{file_name(case['case_id'])}"
    stem.parent.mkdir(parents=True, exist_ok=True)
    record = {"at": at, "reviewer": reviewer, "verdict": verdict, "note": note, "case_id": case["case_id"], "passed": case["passed"], "names": list(case["names"])}
    stem.with_name(stem.name + ".json").write_text(json.dumps(record, indent=2, sort_keys=True, ensure_ascii=False) + "\n", encoding="utf-8")
    lines = [f"# Review of {case['case_id']}", "", f"- At: {at}", f"- Reviewer: {reviewer}", f"- Verdict: {verdict}"] + ([f"- Note: {note}"] if note else [])
    stem.with_name(stem.name + ".md").write_text("\n".join([*lines, f"- Results: {', '.join(case['names']) or 'none'}"]) + "\n", encoding="utf-8")
    return str(stem)
