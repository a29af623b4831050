"""Registers: the likeliest place of every row, what a register run changes, and the diagnostics that it leaves.

The likeliest place is found by branch and bound. The likeness of two names is the larger of their shared words' share and of the matching blocks'
share of their sorted words. A first candidate comes from one place name for each word. Names that share enough words to do better meet by an
equi-join on a row's rarest words. Names whose matching blocks could do better have lengths that differ little: a row's name goes to the blocks
of such lengths, where the letters that two names share, and then their longest common subsequence, bound what their blocks can match; candidates are compared in
falling order of that bound, until none can beat the best.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.rounding import py_round
from cairn.functions.text import ascii_slug, historic_forms, historic_name, jaccard, name_words, plain_letters
from cairn.operators.editorial import pending
from cairn.operators.explain import why_not_linked
from cairn.operators.matching import sequence_ratio
from cairn.sources.scratch import written

#: What a historical place has on top of its likeness, and the most that a confidence can be.
HISTORICAL, MOST = 0.05, 0.99
#: Names of a block, and lengths that share a block.
BLOCK, LENGTHS = 1 << 14, 16
_ALPHABET = " abcdefghijklmnopqrstuvwxyz0123456789"
_BEST = "struct<confidence:double,before:bigint,likeness:double>"


def _candidate(likeness: Column, historical: Column, poi_id: Column) -> Column:
    """Orders candidates: by confidence, then by smaller poi_id."""
    confidence = F.least(py_round(likeness + F.when(historical, HISTORICAL).otherwise(0.0), 4), F.lit(MOST))
    return F.struct(confidence.alias("confidence"), (-poi_id).alias("before"), likeness.alias("likeness"))


def _formed(names: DataFrame, *keep: str) -> DataFrame:
    """The keys to keep, form and text, the sorted words, of each form of each name; text is empty where there are no words."""
    forms = names.select(*keep, F.explode(historic_forms(F.col("name"))).alias("form"))
    return forms.withColumn("text", F.array_join(F.array_sort(name_words(F.col("form"))), " "))


def _called(places: DataFrame, aliases: DataFrame) -> DataFrame:
    """poi_id, via (0: the place's own name, 1: an alias), name."""
    own = places.select("poi_id", F.lit(0).alias("via"), F.col("canonical_name").alias("name"))
    return own.unionByName(aliases.select("poi_id", F.lit(1).alias("via"), F.col("alias_name").alias("name"))).where("name is not null")


def _letters(texts: list[str]) -> np.ndarray:
    """How often each letter stands in each text."""
    out = np.zeros((len(texts), len(_ALPHABET)), np.int32)
    place = np.full(128, -1)
    place[[ord(c) for c in _ALPHABET]] = np.arange(len(_ALPHABET))
    for i, text in enumerate(texts):
        out[i] = np.bincount(place[np.frombuffer(text.encode(), np.uint8)], minlength=len(_ALPHABET))
    return out


def _common(text: str, codes: np.ndarray) -> np.ndarray:
    """The length of the longest common subsequence of a text and of each row of codes (places in the alphabet, -1 behind the end), for texts of up to 64
    letters; of a longer text the length itself. Bit-parallel: a bit of the state for each letter of the text, a column of codes at a time."""
    if len(text) > 64:
        return np.full(len(codes), len(text))
    masks = np.zeros(len(_ALPHABET) + 1, np.uint64)
    for i, c in enumerate(text):
        masks[_ALPHABET.index(c)] |= np.uint64(1 << i)
    state = np.full(len(codes), (1 << len(text)) - 1, np.uint64)
    every = np.uint64((1 << len(text)) - 1)
    for column in codes.T:
        met = state & masks[column]
        state = (state + met) | (state - met)
    return len(text) - np.bitwise_count(state & every).astype(np.int64)


def _codes(texts: list[str]) -> np.ndarray:
    place = np.full(128, -1)
    place[[ord(c) for c in _ALPHABET]] = np.arange(len(_ALPHABET))
    out = np.full((len(texts), max(map(len, texts))), -1)
    for i, text in enumerate(texts):
        out[i, : len(text)] = place[np.frombuffer(text.encode(), np.uint8)]
    return out


def _compared(asked: DataFrame, held: DataFrame, longest: int) -> DataFrame:
    """text, best, compared: what matching blocks find for each name asked, that is as good as its best so far at least, and how many names it was
    compared with. asked: text, best; held: text, historical, poi_id."""
    sized = held.groupBy("text").agg(F.collect_list(F.struct("historical", "poi_id")).alias("kinds")).withColumn("size", F.floor(F.length("text") / LENGTHS).cast("int"))
    blocks = sized.groupBy("size").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    stored = sized.join(blocks, "size").select(
        "size", F.pmod(F.xxhash64("text"), F.col("blocks")).cast("int").alias("block"), F.lit(False).alias("asks"), "text", "kinds", F.lit(0.0).alias("confidence")
    )
    # With blocks of m letters the likeness is 2m / (a + b), and m is the shorter length at most.
    least = F.greatest(F.col("best.confidence") - (HISTORICAL + 0.0001), F.lit(0.0))
    own = F.length("text")
    low = F.greatest(F.lit(1), F.floor(own * least / (2 - least)).cast("int"))
    high = F.when(least > 0, F.least(F.lit(longest), F.ceil(own * (2 - least) / least).cast("int"))).otherwise(F.lit(longest))
    reach = asked.select("text", "best.confidence", F.explode(F.sequence(F.floor(low / LENGTHS).cast("int"), F.floor(F.greatest(low, high) / LENGTHS).cast("int"))).alias("size")).join(blocks, "size")
    copies = reach.select("size", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("asks"), "text", F.lit(None).cast(sized.schema["kinds"].dataType).alias("kinds"), "confidence")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, names, counts, matcher = None, [], None, SequenceMatcher(None)
        for batch in batches:
            out = []
            for size, block, asks, text, kinds, confidence in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group != (size, block):
                    group, names, counts = (size, block), [], None
                if not asks:
                    names.append((text, kinds))
                    continue
                if not names:
                    continue
                if counts is None:
                    texts = [n for n, _ in names]
                    counts, codes, lengths = _letters(texts), _codes(texts), np.array([len(n) for n in texts])
                    bonus = np.array([max(HISTORICAL if k["historical"] else 0.0 for k in ks) for _, ks in names])
                best, calls = (confidence, None, 0.0), 0
                bound = lambda shared, at: np.minimum(2 * shared / (len(text) + lengths[at]) + bonus[at] + 0.0001, MOST)  # noqa: B023, E731
                every = np.arange(len(names))
                at = every[bound(np.minimum(counts, _letters([text])[0]).sum(axis=1), every) >= confidence]
                could = bound(_common(text, codes[at]), at)
                matcher.set_seq1(text)
                order = np.argsort(-could, kind="stable")
                for i, most in zip(at[order].tolist(), could[order].tolist(), strict=True):
                    if most < best[0]:
                        break
                    name, ks = names[i]
                    matcher.set_seq2(name)
                    likeness = matcher.ratio()
                    calls += 1
                    for k in ks:
                        found = (min(round(likeness + (HISTORICAL if k["historical"] else 0.0), 4), MOST), -k["poi_id"], likeness)
                        if found[0] > best[0] or found[0] == best[0] and (best[1] is None or found[1:] > best[1:]):
                            best = found
                out.append((text, None if best[1] is None else {"confidence": best[0], "before": best[1], "likeness": best[2]}, calls))
            if out:
                types = (pa.string(), pa.struct([("confidence", pa.float64()), ("before", pa.int64()), ("likeness", pa.float64())]), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["text", "best", "compared"])

    dealt = stored.unionByName(copies).repartition("size", "block").sortWithinPartitions("size", "block", "asks")
    found = dealt.mapInArrow(run, f"text string, best {_BEST}, compared long")
    return found.groupBy("text").agg(F.max("best").alias("best"), F.sum("compared").alias("compared"))


def likeliest(asked: DataFrame, held: DataFrame) -> DataFrame:
    """text, best (confidence, before: the negative poi_id, likeness), compared. asked: text (distinct); held: text, historical, poi_id (the smallest of its kind).
    Texts are sorted words. A text that is like none has no row or no best."""
    words = lambda df: df.withColumn("words", F.split("text", " "))
    listed = words(held).select("text", "historical", "poi_id", "words", F.explode("words").alias("word"))
    # One name a word, that of the fewest words, gives every name that shares a word a first candidate.
    chosen = listed.groupBy("word").agg(F.min(F.struct(F.size("words").alias("n"), "text", "historical", "poi_id")).alias("first"), F.count(F.lit(1)).alias("many"))
    own = words(asked).select("text", "words", F.explode("words").alias("word")).join(chosen, "word", "left")
    other = F.col("first.text")
    likeness = F.greatest(jaccard(F.col("words"), F.split(other, " ")), sequence_ratio(F.col("text"), other))
    seeds = own.where("first is not null").select("text", "words", F.col("first.historical").alias("historical"), F.col("first.poi_id").alias("poi_id"), likeness.alias("likeness"))
    seeds = seeds.groupBy("text").agg(F.max(_candidate(F.col("likeness"), F.col("historical"), F.col("poi_id"))).alias("best"), F.count(F.lit(1)).alias("compared"))
    # To share so many words, two names share one of the rarest of either; words that no place has come first.
    ranks = own.groupBy("text", "words").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("many", F.lit(0)).alias("many"), "word"))).alias("rare"))
    least = F.greatest(F.col("best.confidence") - (HISTORICAL + 0.0001), F.lit(0.0001))
    n = F.size("words")
    probes = ranks.join(seeds.select("text", "best"), "text").withColumn("least", least)
    probes = probes.select("text", "words", "best", "least", F.explode(F.slice("rare", F.lit(1), n - F.ceil(n * F.col("least")).cast("int") + 1)).alias("rare"))
    probes = probes.select("text", "words", "best", "least", F.col("rare.word").alias("word"))
    theirs = listed.select(F.col("text").alias("other"), F.col("words").alias("others"), "historical", "poi_id", "word")
    fits = (F.size("others") >= F.size("words") * F.col("least")) & (F.size("others") * F.col("least") <= F.size("words"))
    met = probes.join(theirs, "word").where(fits).withColumn("likeness", jaccard(F.col("words"), F.col("others"))).where("likeness >= least")
    by_words = met.groupBy("text").agg(F.max(_candidate(F.col("likeness"), F.col("historical"), F.col("poi_id"))).alias("best"))
    none = F.struct(F.lit(0.0).alias("confidence"), F.lit(None).cast("long").alias("before"), F.lit(0.0).alias("likeness"))
    first = asked.join(seeds.withColumnRenamed("best", "seed"), "text", "left").join(by_words.withColumnRenamed("best", "shared"), "text", "left")
    first = first.select("text", F.coalesce(F.greatest("seed", "shared"), none).alias("best"), F.coalesce("compared", F.lit(0)).alias("compared"))
    longest = held.agg(F.max(F.length("text"))).first()[0] or 1
    by_blocks = _compared(first.select("text", "best"), held, longest).withColumnsRenamed({"best": "blocks", "compared": "more"})
    out = first.join(by_blocks, "text", "left").select("text", F.greatest("best", "blocks").alias("best"), (F.col("compared") + F.coalesce("more", F.lit(0))).alias("compared"))
    return out.where("best.before is not null")


def exact(names: DataFrame, places: DataFrame, aliases: DataFrame) -> DataFrame:
    """row_id, poi_id, matched_name, method: for each register row (row_id, name) the first place in order of poi_id of which a name or alias has a form in common. Within
    a place the name goes before an alias, aliases go by name."""
    forms = lambda df, *keep: df.select(*keep, F.explode(historic_forms(F.col("name"))).alias("form"))
    return _equal(forms(names, "row_id"), forms(_called(places, aliases), "poi_id", "via", "name"))


def _equal(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    # One place a form, so a form that many places have makes no pairs.
    held = theirs.groupBy("form").agg(F.min(F.struct("poi_id", "via", F.col("name").alias("matched_name"))).alias("first"))
    met = mine.select("row_id", "form").join(held, "form").groupBy("row_id").agg(F.min("first").alias("first"))
    return met.select("row_id", "first.poi_id", "first.matched_name", F.when(F.col("first.via") == 0, "canonical_exact").otherwise("alias_exact").alias("method"))


def matches(rows: DataFrame, places: DataFrame, aliases: DataFrame, threshold: float) -> DataFrame:
    """row_id, poi_id, matched_name, method, likeness, confidence, accepted, compared of every register row (row_id, names), as _matches finds them. Rows with the same
    names are matched once; rows that repeat a row_id count each. Null names are none."""
    rows = rows.select("row_id", F.coalesce("names", F.array().cast("array<string>")).alias("names"))
    found = _matches(rows.select(F.col("names").alias("row_id"), "names").distinct(), places, aliases, threshold).withColumnRenamed("row_id", "names")
    return rows.join(found, "names").select("row_id", *(c for c in found.columns if c != "names"))


def _matches(rows: DataFrame, places: DataFrame, aliases: DataFrame, threshold: float) -> DataFrame:
    """The matches of rows whose row_id differ.

    Rows that share a form with a place's name or alias are settled by equality. For the others it is the place of the highest confidence, ties to the smaller
    poi_id, accepted if its likeness reaches the threshold; matched_name is the place's likeliest name for it (ties: the row's earlier name, then
    the place's own name, then aliases by name; without any likeness the place's own name). A row without a name, or like no place, takes the
    first historical place, else the first, at likeness 0. Without places there are no rows.

    places: poi_id, canonical_name, is_historical; aliases: poi_id, alias_name.
    """
    historical = F.coalesce("is_historical", F.lit(False))
    mine = written(_formed(rows.select("row_id", F.posexplode("names").alias("at", "name")), "row_id", "at"), "register-rows")
    theirs = written(_formed(_called(places, aliases).repartition("poi_id"), "poi_id", "via", "name").join(places.select("poi_id", historical.alias("historical")), "poi_id"), "register-names")
    settled = _equal(mine, theirs).select("row_id", "poi_id", "matched_name", "method", F.lit(1.0).alias("likeness"), F.lit(MOST).alias("confidence"), F.lit(True).alias("accepted"), F.lit(0).cast("long").alias("compared"))
    first = places.agg(F.max(_candidate(F.lit(0.0), historical, F.col("poi_id").cast("long"))).alias("least")).first()["least"]
    if first is None:
        return settled
    least = F.struct(F.lit(first["confidence"]).alias("confidence"), F.lit(first["before"]).cast("long").alias("before"), F.lit(0.0).alias("likeness"))
    left = rows.select("row_id").distinct().join(settled, "row_id", "left_anti")
    asked = mine.where("text <> ''").select("row_id", "text").distinct().join(left, "row_id")
    held = theirs.where("text <> ''").groupBy("text", "historical").agg(F.min(F.col("poi_id").cast("long")).alias("poi_id"))
    best = likeliest(written(asked.select("text").distinct(), "register-asked"), written(held, "register-held"))
    found = left.join(asked, "row_id", "left").join(best, "text", "left").groupBy("row_id").agg(F.max("best").alias("best"), F.coalesce(F.sum("compared"), F.lit(0)).cast("long").alias("compared"))
    found = found.withColumn("best", F.greatest(F.coalesce("best", least), least)).select("row_id", (-F.col("best.before")).alias("poi_id"), "best.likeness", "best.confidence", "compared")
    # Which of the place's names it was.
    found = written(found, "register-found")
    others = theirs.where("text <> ''").select("poi_id", F.when(F.col("via") == 0, "").otherwise(F.col("name")).alias("alias"), F.col("name").alias("matched_name"), F.col("text").alias("other"))
    pairs = found.where("likeness > 0").select("row_id", "poi_id").join(mine.where("text <> ''"), "row_id").join(others, "poi_id")
    pairs = pairs.withColumn("like", F.greatest(jaccard(F.split("text", " "), F.split("other", " ")), sequence_ratio(F.col("text"), F.col("other"))))
    named = pairs.groupBy("row_id").agg(F.min(F.struct((-F.col("like")).alias("like"), "at", "alias", "matched_name")).alias("name")).select("row_id", "name.matched_name")
    own = places.select("poi_id", "canonical_name")
    fuzzy = found.join(named, "row_id", "left").join(own, "poi_id").select(
        "row_id", "poi_id", F.coalesce("matched_name", "canonical_name").alias("matched_name"), F.lit("fuzzy_fallback").alias("method"), "likeness", "confidence", (F.col("likeness") >= threshold).alias("accepted"), "compared"
    )
    return settled.unionByName(fuzzy)


def evidence_key(poi_id: Column, source_id: str, record: Column) -> Column:
    return F.substring(ascii_slug(plain_letters(F.concat_ws(":", poi_id.cast("string"), F.lit(source_id), record))), 1, 255)


def run(rows: DataFrame, found: DataFrame, evidence: DataFrame, diagnostics: DataFrame, places: DataFrame, source_id: str, region: str, evidence_type: str, text: Column) -> dict[str, DataFrame]:
    """What a run of one register over one region leaves: evidence, diagnostics, touched (poi_id) and counts, all lazily.

    rows: row_id, reference_number, property_name, and what `text` needs; found: as matches() gives it; places: poi_id, city. Evidence of this source for places of the region
    is replaced, as are the region's diagnostics of this source; all else stays. Every accepted row is a row of evidence, its confidence rounded to three places; every other row
    is a diagnostic with its best candidate, unreviewed. touched are the places that lost or gained evidence.

    evidence: evidence_key, poi_id, source_id, evidence_type, label, text, record_id, confidence; diagnostics: source_id, region, record_id, external_name, matched_poi_id,
    best_name, best_similarity, match_strategy, status.
    """
    here = places.where(F.col("city") == region).select("poi_id")
    old = evidence.where(F.col("source_id") == source_id).join(here, "poi_id", "left_semi")
    kept = evidence.where(F.col("source_id") != source_id).unionByName(evidence.where(F.col("source_id") == source_id).join(here, "poi_id", "left_anti"))
    record = F.coalesce(F.nullif("reference_number", F.lit("")), "property_name")
    met = rows.join(found, "row_id", "left").withColumn("taken", F.coalesce("accepted", F.lit(False)))
    new = met.where("taken").select(
        evidence_key(F.col("poi_id"), source_id, record).alias("evidence_key"), "poi_id", F.lit(source_id).alias("source_id"), F.lit(evidence_type).alias("evidence_type"),
        F.col("property_name").alias("label"), text.alias("text"), record.alias("record_id"), py_round(F.col("confidence"), 3).alias("confidence"),
    )
    missed = met.where("not taken").select(
        F.lit(source_id).alias("source_id"), F.lit(region).alias("region"), record.alias("record_id"), F.col("property_name").alias("external_name"), F.col("poi_id").alias("matched_poi_id"),
        F.col("matched_name").alias("best_name"), F.col("likeness").alias("best_similarity"), F.col("method").alias("match_strategy"), F.lit("unreviewed").alias("status"),
    )
    counts = met.agg(F.count(F.lit(1)).alias("candidate_rows"), F.count_if("taken").alias("evidence_created"), F.count_if(~F.col("taken")).alias("unmatched_rows"), F.count_distinct(F.when(F.col("taken"), F.col("poi_id"))).alias("impacted_places"))
    return {
        "evidence": kept.select(*new.columns).unionByName(new),
        "diagnostics": diagnostics.where(~((F.col("source_id") == source_id) & (F.col("region") == region))).select(*missed.columns).unionByName(missed),
        "touched": old.select("poi_id").unionByName(new.select("poi_id")).distinct(),
        "counts": counts,
    }


def diagnostic_items(diagnostics: DataFrame, sources: DataFrame, places: DataFrame, status: str = "unreviewed", region: str | None = None, source_id: str | None = None) -> DataFrame:
    """diagnostics as a reviewer sees them: with the source's name and type, the candidate's and the resolved place's names, each null or the diagnostic's own where there is
    none, and why the row wasn't linked by itself. diagnostics: id, external_name, source_id, region, status, matched_poi_id, best_name, resolved_poi_id, best_similarity, match_strategy, resolution_method,
    updated_at; sources: source_id, source_name, source_type; places: poi_id, canonical_name."""
    rows = diagnostics.where(pending(status, F.col("status")))
    for column, value in (("region", region), ("source_id", source_id)):
        rows = rows if value is None else rows.where(F.col(column) == value)
    rows = rows.join(sources.select("source_id", "source_name", "source_type"), "source_id", "left")
    rows = rows.join(places.select(F.col("poi_id").alias("matched_poi_id"), F.col("canonical_name").alias("candidate")), "matched_poi_id", "left")
    rows = rows.join(places.select(F.col("poi_id").alias("resolved_poi_id"), F.col("canonical_name").alias("resolved_name")), "resolved_poi_id", "left")
    rows = rows.withColumns({"why_not_linked": why_not_linked(), "normalized_name": historic_name(F.col("external_name"), relaxed=True)})
    return rows.withColumn("best_name", F.coalesce("candidate", "best_name")).drop("candidate")
