"""Runs that change only what they touch: evidence replaced by source, carried on to signals, memberships and links; and committed as one version.

Nothing outside the touched places is worked out again, and a stamp moves only where a value has changed.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators import themes
from cairn.operators.evidence import rollup

SIGNALS = ("official", "district", "institutional", "heritage")
_VALUES = ("status", "basis", "confidence", "rationale")


def replaced(stored: DataFrame, fresh: DataFrame, places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Evidence after a run: stored rows of the run's sources for its places go, fresh ones come. Also touched (poi_id): places whose rows differ
    from before, however often a row repeats. stored, fresh: the same columns, with poi_id and source_id; places: poi_id of the region. A run's sources are few and go to every
    task: a join by source would bring all rows of one into one task."""
    sources = F.broadcast(fresh.select("source_id").distinct())
    here = stored.join(sources, "source_id", "left_semi").join(places.select("poi_id"), "poi_id", "left_semi")
    own = [c for c in stored.columns if c != "observed_at"]
    rest = stored.join(sources, "source_id", "left_anti").unionByName(stored.join(sources, "source_id", "left_semi").join(places.select("poi_id"), "poi_id", "left_anti"))
    count = lambda df, by: df.select("poi_id", F.xxhash64(*own).alias("row"), F.xxhash64(F.lit(1), *own).alias("row2"), F.lit(by).alias("by"))
    sides = count(here, -1).unionByName(count(fresh.select(*stored.columns), 1)).groupBy("poi_id", "row", "row2").agg(F.sum("by").alias("by"))
    return rest.unionByName(fresh.select(*stored.columns)), sides.where("by <> 0").select("poi_id").distinct()


def signals_after(signals: DataFrame, evidence: DataFrame, touched: DataFrame, now: Column) -> DataFrame:
    """signals (poi_id, official, district, institutional, heritage, computed_at) with those of touched places summed again over their evidence (none: 0). A place without
    a row gets one; computed_at is `now` where a value has changed."""
    fresh = rollup(evidence.join(touched, "poi_id", "left_semi"))
    fresh = touched.join(fresh, "poi_id", "left").na.fill({"official": 0.0, "district": 0.0, "institutional": 0.0, "heritage": False})
    new = fresh.select("poi_id", F.struct(*SIGNALS).alias("new"))
    both = signals.select("poi_id", F.struct(*SIGNALS).alias("old"), "computed_at").join(new, "poi_id", "full")
    stamp = F.when(F.col("new").isNull() | F.col("new").eqNullSafe(F.col("old")), F.col("computed_at")).otherwise(now)
    return both.select("poi_id", *(F.coalesce(f"new.{c}", f"old.{c}").alias(c) for c in SIGNALS), stamp.alias("computed_at"))


def memberships_after(stored: DataFrame, places: DataFrame, evidence: DataFrame, touched: DataFrame, now: Column) -> DataFrame:
    """Theme memberships (poi_id, theme, status, basis, confidence, rationale, evidence_ids, computed_at) with those of touched places evaluated again. stored: the same columns; places:
    a place frame with aliases; evidence: poi_id, evidence_id, haystack. A membership that no longer holds goes; evidence_ids are its links. Memberships of themes without an evaluator stay."""
    found = themes.theme_evidence(evidence.join(touched, "poi_id", "left_semi"))
    none = F.array().cast("array<bigint>")
    rows = places.join(touched, "poi_id", "left_semi").join(found, "poi_id", "left").withColumns({c: F.coalesce(c, none) for c in ("water_ids", "rail_ids")})
    fresh = themes.evaluated(rows)
    old = stored.where(F.col("theme").isin(*themes.EVALUATORS)).join(touched, "poi_id", "left_semi")
    rest = stored.where(~F.col("theme").isin(*themes.EVALUATORS)).unionByName(stored.where(F.col("theme").isin(*themes.EVALUATORS)).join(touched, "poi_id", "left_anti"))
    keys = ["poi_id", "theme"]
    both = fresh.select(*keys, F.struct(*_VALUES, "evidence_ids").alias("new")).join(old.select(*keys, F.struct(*_VALUES).alias("old"), "computed_at"), keys, "left")
    stamp = F.when(F.col("old").eqNullSafe(F.struct(*(F.col(f"new.{c}").alias(c) for c in _VALUES))), F.col("computed_at")).otherwise(now)
    return rest.unionByName(both.select(*keys, "new.*", stamp.alias("computed_at")).select(*stored.columns))


def layer_run(stored: dict[str, DataFrame], fresh: DataFrame, region: DataFrame, now: Column) -> dict[str, DataFrame]:
    """evidence, touched, signals and memberships after a run. stored: evidence, signals, memberships, places (a place frame with aliases); fresh: the run's evidence;
    region: poi_id of its places."""
    evidence, touched = replaced(stored["evidence"], fresh, region)
    return {
        "evidence": evidence, "touched": touched, "signals": signals_after(stored["signals"], evidence, touched, now),
        "memberships": memberships_after(stored["memberships"], stored["places"], evidence, touched, now),
    }


class Conflict(Exception):
    """Another commit came first, or the tables to commit break a rule."""


class Store:
    """Versions of a set of tables in a folder. A version is a small manifest that names a written table each; readers follow the highest one.

    commit() writes the new tables beside the old, checks them, and then creates the next version's manifest, which only one of several writers can do.
    Whoever loses, or whose tables break a rule, leaves the old version as it is. Files go through Spark's own file systems, so any shared store will do whose create-if-absent
    is atomic (HDFS and local folders are).
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._at = lambda name: hadoop.Path(f"{self.path}/{name}")
        self._fs = hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """0 before the first commit."""
        if not self._fs.exists(self._at("versions")):
            return 0
        return max((int(f.getPath().getName()) for f in self._fs.listStatus(self._at("versions")) if f.getPath().getName().isdigit()), default=0)

    def _manifest(self, version: int) -> dict:
        return json.loads("\n".join(r[0] for r in self.spark.read.text(f"{self.path}/versions/{version:012d}").collect())) if version else {"tables": {}}

    def read(self, version: int | None = None) -> dict[str, DataFrame]:
        return {name: self.spark.read.parquet(f"{self.path}/{at}") for name, at in self._manifest(self.version() if version is None else version)["tables"].items()}

    def log(self, run: str, state: str, **more) -> None:
        """A line of the run log: a file each, so that writers don't meet."""
        row = {"run": run, "state": state, "at": time.time(), "more": json.dumps(more)}
        self.spark.createDataFrame([row], "run string, state string, at double, more string").coalesce(1).write.mode("append").parquet(f"{self.path}/log")

    def runs(self) -> DataFrame:
        """The last state of each run: running, completed or failed."""
        rows = self.spark.read.parquet(f"{self.path}/log")
        return rows.groupBy("run").agg(F.max_by(F.struct("state", "at", "more"), F.struct("at", F.col("state") != "running")).alias("last")).select("run", "last.*")

    def stage(self, name: str, df: DataFrame) -> str:
        """Writes a table for a later commit and returns where it is: what builds on it reads it by at(), so it isn't worked out again."""
        path = f"tables/{name}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{path}")
        return path

    def at(self, path: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{path}")

    def commit(self, tables: dict[str, DataFrame | str], base: int, keys: dict[str, list[str]] | None = None, parents: list[tuple[str, list[str], str, list[str]]] | None = None) -> int:
        """The new version, of frames or staged tables. Tables that aren't given are taken over from `base`, the version that they were worked out from.

        keys: columns that name a row of a table, none of them null; parents: (table, columns, other table, its columns), where each row's columns must stand in the other table, unless one
        of them is null. A rule that is broken, or a version that isn't `base` any more, raises Conflict."""
        names = dict(self._manifest(base)["tables"])
        for name, df in tables.items():
            names[name] = df if isinstance(df, str) else self.stage(name, df)
        new = {name: self.at(at) for name, at in names.items()}
        for name, columns in (keys or {}).items():
            if name in tables:
                if not new[name].groupBy(*columns).count().where("count > 1").isEmpty():
                    raise Conflict(f"{name}: rows repeat {columns}")
                if not new[name].where(" OR ".join(f"`{c}` IS NULL" for c in columns)).isEmpty():
                    raise Conflict(f"{name}: {columns} hold nulls")
        for name, columns, other, theirs in parents or ():
            if name in tables or other in tables:
                lost = new[name].select(*columns).na.drop("any").distinct().join(new[other].select(*(F.col(t).alias(c) for c, t in zip(columns, theirs, strict=True))), columns, "left_anti")
                if not lost.isEmpty():
                    raise Conflict(f"{name}: {columns} that {other} doesn't have")
        return self._publish(base, names)

    def _publish(self, base: int, names: dict[str, str]) -> int:
        if self.version() != base:
            raise Conflict(f"version {base} isn't the last one any more")
        self._fs.mkdirs(self._at("versions"))
        draft = self._at(f"drafts/{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps({"tables": names}).encode()))
        out.close()
        target = self._at(f"versions/{base + 1:012d}")
        try:
            claim = self._fs.create(self._at(f"claims/{base + 1:012d}"), False)  # fails where it is there already
            claim.close()
        except Exception as error:
            raise Conflict(f"version {base + 1} is another's") from error
        if not self._fs.rename(draft, target):
            raise Conflict(f"version {base + 1} couldn't be created")
        return base + 1

    def release(self, version: int) -> None:
        """Takes back the claim on a version that a lost writer never created."""
        if self.version() < version:
            self._fs.delete(self._at(f"claims/{version:012d}"), False)


def recorded(store: Store, kind: str, work: Callable[[dict[str, DataFrame]], dict[str, DataFrame]], **rules) -> int:
    """Does work on the last version and commits it; the run log tells running, then completed or failed with the reason, which is raised again."""
    run, base = f"{kind}-{uuid.uuid4().hex}", store.version()
    store.log(run, "running", base=base)
    try:
        version = store.commit(work(store.read(base)), base, **rules)
    except Exception as error:
        store.log(run, "failed", reason=str(error)[:500])
        raise
    store.log(run, "completed", version=version)
    return version
