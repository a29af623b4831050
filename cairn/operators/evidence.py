"""Roll-up of evidence into ranking signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions import vocab
from cairn.functions.rounding import py_round


def _weight(place: int) -> Column:
    out = F.lit(0.0)
    for kind, w in vocab.EVIDENCE.items():
        value = F.lit(w[place])
        if place == 1 and w[4]:
            value = F.when(F.upper(F.coalesce("property_category", F.lit(""))).contains("DISTRICT"), w[4]).otherwise(w[1])
        out = F.when(F.col("evidence_type") == kind, value).otherwise(out)
    return out


def rollup(evidence: DataFrame) -> DataFrame:
    """poi_id, official, district, institutional (each at most 1), heritage. evidence: poi_id, evidence_type, property_category.
    Weights are added as exact decimals, so the sum doesn't depend on the order of rows; partial sums move, not rows."""
    heritage = [k for k, w in vocab.EVIDENCE.items() if w[3]]

    def capped(place: int) -> Column:
        return F.least(F.lit(1.0), F.sum(_weight(place).cast("decimal(12,2)")).cast("double"))

    return evidence.groupBy("poi_id").agg(capped(0).alias("official"), capped(1).alias("district"), capped(2).alias("institutional"), F.bool_or(F.col("evidence_type").isin(heritage)).alias("heritage"))


def recomputed(signals: DataFrame, evidence: DataFrame) -> DataFrame:
    """signals (poi_id, local_identity, editorial_seed) with the roll-up of all evidence; places without any go to zero."""
    rows = signals.join(rollup(evidence), "poi_id", "left").na.fill({"official": 0.0, "district": 0.0, "institutional": 0.0, "heritage": False})
    local = F.greatest("local_identity", py_round(0.4 + 0.3 * F.col("district") + 0.3 * F.col("institutional"), 4))
    return rows.withColumns({"local_identity": local, "editorial_seed": F.greatest("editorial_seed", py_round(0.4 + 0.4 * F.col("official"), 4))})
