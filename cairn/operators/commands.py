"""Editorial commands, folded in order over the state of each diagnostic: resolve, alias, suppress.

A diagnostic that has been reviewed takes only the same review again; anything else is refused and changes nothing. Commands on a place that
doesn't exist are refused; so are aliases that another place owns already, or that an earlier command has given to another place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.text import historic_name

_STATE = "struct<status:string,poi:bigint,method:string,by:string,aliases:array<string>,applied:int,refused:array<bigint>>"


def _wanted(commands: DataFrame, diagnostics: DataFrame, places: DataFrame) -> DataFrame:
    """commands (seq, id, action, poi_id, alias_name, reviewed_by) with to (the status that they ask for), method, alias (normalized) and known (whether the place exists)."""
    rows = commands.join(diagnostics.select("id", "external_name"), "id").join(places.select("poi_id", F.lit(True).alias("known")).distinct(), "poi_id", "left")
    alias = F.when(F.col("action") == "alias", historic_name(F.coalesce("alias_name", "external_name")))
    method = F.when(F.col("action") == "resolve", "manual_link").when(F.col("action") == "alias", "manual_alias").otherwise("suppressed")
    to = F.when(F.col("action") == "suppress", "suppressed").otherwise("resolved")
    poi = F.when(F.col("action") != "suppress", F.col("poi_id"))
    return rows.select("seq", "id", poi.cast("long").alias("poi"), to.alias("to"), method.alias("method"), "reviewed_by", alias.alias("alias"), ((F.col("action") == "suppress") | F.coalesce("known", F.lit(False))).alias("known"))


def _alias_allowed(wanted: DataFrame, aliases: DataFrame) -> DataFrame:
    """wanted with free: whether no other place has the alias, from before or by an earlier command. Owners are added up by alias first, and an alias goes to the first command
    that asks for it, whether or not that is applied, so that the outcome of one diagnostic doesn't depend on another's."""
    owners = aliases.groupBy(F.col("normalized_alias").alias("alias")).agg(F.min("poi_id").alias("low"), F.max("poi_id").alias("high"))
    first = wanted.where("alias is not null and known").groupBy("alias").agg(F.min_by("poi", "seq").alias("first"))
    rows = wanted.join(owners, "alias", "left").join(first, "alias", "left")
    own = (F.coalesce("low", "poi") == F.col("poi")) & (F.coalesce("high", "poi") == F.col("poi"))
    free = F.col("alias").isNull() | (own & F.when(F.col("low").isNull(), F.col("first") == F.col("poi")).otherwise(True))
    return rows.withColumn("free", F.coalesce(free, F.lit(False))).drop("low", "high", "first")


def folded(diagnostics: DataFrame, commands: DataFrame, places: DataFrame, aliases: DataFrame) -> dict[str, DataFrame]:
    """diagnostics after all commands in order of seq, the commands' outcomes, the aliases that they made, and links (id, poi_id, method): the evidence to be made.

    diagnostics: id, external_name, status, resolved_poi; commands: seq (unique), id, action (resolve, alias or suppress), poi_id, alias_name (null: the diagnostic's own name), reviewed_by; places:
    poi_id; aliases: poi_id, normalized_alias. Commands on a diagnostic that doesn't exist are refused. The commands of one diagnostic are folded
    in one row; they are a reviewer's clicks.
    """
    wanted = _alias_allowed(_wanted(commands, diagnostics, places), aliases)
    listed = wanted.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("seq", "poi", "to", "method", "reviewed_by", "alias", "known", "free"))).alias("steps"))
    rows = diagnostics.select("id", "external_name", "status", F.col("resolved_poi").cast("long").alias("resolved_poi")).join(listed, "id", "left")
    fold = F.expr(f"""aggregate(coalesce(steps, array()), cast(struct(status, resolved_poi, null, null, array(), 0, array()) as {_STATE}), (s, c) ->
        if(c.known and c.free and (s.status in ('unreviewed', 'unmatched') or (s.status = c.to and s.poi <=> c.poi)),
           cast(struct(c.to, c.poi, c.method, c.reviewed_by, if(c.alias is null, s.aliases, array_union(s.aliases, array(c.alias))), s.applied + 1, s.refused) as {_STATE}),
           cast(struct(s.status, s.poi, s.method, s.by, s.aliases, s.applied, concat(s.refused, array(c.seq))) as {_STATE})))""")  # fmt: skip
    done = rows.withColumn("end", fold)
    refused = done.select("id", F.explode("end.refused").alias("seq")).select("seq", F.lit("refused").alias("outcome"))
    outcomes = commands.select("seq", "id").join(refused, "seq", "left").join(diagnostics.select("id", F.lit(True).alias("there")), "id", "left")
    outcome = F.when(F.col("there").isNull(), "refused").otherwise(F.coalesce("outcome", F.lit("applied")))
    after = done.select("id", "external_name", F.col("end.status").alias("status"), F.col("end.poi").alias("resolved_poi"), F.col("end.method").alias("resolution_method"), F.col("end.by").alias("reviewed_by"))
    made = done.select(F.col("end.poi").alias("poi_id"), F.explode("end.aliases").alias("normalized_alias")).distinct()
    links = done.where("end.applied > 0 and end.status = 'resolved'").select("id", F.col("end.poi").alias("poi_id"), F.col("end.method").alias("method"))
    return {"diagnostics": after, "outcomes": outcomes.select("seq", "id", outcome.alias("outcome")), "aliases": made.join(aliases.select("poi_id", "normalized_alias"), ["poi_id", "normalized_alias"], "left_anti"), "links": links}
