"""Mixing domains to target weights by soft membership. DataFrame functions only.

A table of rates learned from labelled rows gives every document a posterior over the domains. Projected-gradient least
squares then finds a nonnegative rate for each document, so that the expected tokens of the domains meet their targets.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.shared import table, text_or_empty, written

#: Share of the expected tokens that each domain (here: language) is to have.
TARGETS = {"de": 0.18, "en": 0.5, "es": 0.14, "fr": 0.18}
#: Words are hashed to so many rates a domain.
BUCKETS = 4096
#: The model is fitted on the rows of at most so many labelled documents, those of smallest hash.
FIT_ROWS = 20_000
#: A text of more words speaks no louder than one of so many; it keeps membership soft for long texts.
EVIDENCE = 40
ROUNDS = 60


@dataclass
class DomainModel:
    """prior[domain] and rate[domain][bucket]: the share of a domain's words that fall into each bucket."""

    prior: dict[str, float]
    rate: dict[str, list[float]]


def _fixed(values: list, kind: str) -> Column:
    """A list of the driver as one constant, folded before the plan runs."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def _count(text: Column, mark: str) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(mark), F.lit("")))


def tokens(text: Column) -> Column:
    """Words between spaces and line feeds, counted without splitting; 0 for an empty text."""
    return F.when(text == "", 0).otherwise(1 + _count(text, " ") + _count(text, "\n")).cast("double")


def words(text: Column) -> Column:
    """The bucket of each word between spaces and line feeds, in lower case."""
    return F.transform(F.split(F.lower(text), "[ \n]"), lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))


def fit_domains(docs: DataFrame, labels: DataFrame, domains: tuple[str, ...] = tuple(TARGETS), most: int = FIT_ROWS) -> DomainModel:
    """Rates of hashed words in each domain, from the rows of labelled documents (at most `most`, so that their ids fit every task; labels of documents that aren't in docs count among them).
    docs: doc_id, domain, text. A row of counts for each domain and bucket reaches the driver. Labelled rows of other domains, or without one, are left out. A domain without rows keeps flat rates
    and a small prior."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.where(F.col("domain").isin(*domains)).join(F.broadcast(known), "doc_id", "left_semi")
    # A row itself counts as bucket -1: documents and words are counted in one pass.
    held = rows.select("domain", F.explode(F.concat(F.array(F.lit(-1)), words(text_or_empty()))).alias("bucket"))
    found = {d: {} for d in domains}
    for r in held.groupBy("domain", "bucket").count().collect():
        found[r["domain"]][r["bucket"]] = r["count"]
    total = sum(c.get(-1, 0) for c in found.values())
    prior, rate = {}, {}
    for d, c in found.items():
        n = c.pop(-1, 0)
        prior[d] = (n + 1) / (total + len(domains))
        whole = sum(c.values()) + 0.5 * BUCKETS
        rate[d] = [(c.get(b, 0) + 0.5) / whole for b in range(BUCKETS)]
    return DomainModel(prior, rate)


def _told(buckets: Column, rate: list[float]) -> Column:
    """The sum of the logarithms of the buckets' rates."""
    logs = _fixed([math.log(r) for r in rate], "array<double>")
    return F.aggregate(buckets, F.lit(0.0), lambda acc, b: acc + F.get(logs, b))


def with_membership(docs: DataFrame, model: DomainModel, prefix: str = "") -> DataFrame:
    """docs with the tokens of the text and the posterior of each domain in the columns prefix + tokens, p0, p1, ... in the order of model.prior: rates of hashed words, tempered. Each step is a column
    of its own, so that nothing is worked out twice. A task holds the words of one text at a time, some ten times its bytes."""
    domains = range(len(model.prior))
    text = text_or_empty()
    out = docs.withColumns({f"{prefix}tokens": tokens(text), f"{prefix}words": words(text)})
    strength = F.when(F.col(f"{prefix}tokens") == 0, 0.0).otherwise(F.least(F.lit(1.0), F.lit(float(EVIDENCE)) / F.col(f"{prefix}tokens")))
    logits = {}
    for k, d in enumerate(model.prior):
        logits[f"{prefix}l{k}"] = math.log(model.prior[d]) + strength * _told(F.col(f"{prefix}words"), model.rate[d])
    top = [F.col(f"{prefix}l{k}") for k in domains]
    out = out.withColumns(logits).withColumn(f"{prefix}top", F.greatest(*top) if len(top) > 1 else top[0])
    out = out.withColumns({f"{prefix}e{k}": F.exp(F.col(f"{prefix}l{k}") - F.col(f"{prefix}top")) for k in domains})
    whole = sum((F.col(f"{prefix}e{k}") for k in domains), F.lit(0.0))
    return out.withColumns({f"{prefix}p{k}": F.col(f"{prefix}e{k}") / whole for k in domains}).select(*docs.columns, f"{prefix}tokens", *(f"{prefix}p{k}" for k in domains))


@dataclass
class Mixture:
    """The steps that every document's rate has taken, and what they led to."""

    steps: list[list[float]]
    totals: list[float]
    wanted: list[float]

    def rate(self, posterior: list[Column]) -> Column:
        """Rate of a document: from 1, against each step in the direction of its posterior, never below 0."""
        if not self.steps:
            return F.lit(1.0)
        against = lambda y: sum((p * F.get(y, k) for k, p in enumerate(posterior)), F.lit(0.0))
        return F.aggregate(_fixed(self.steps, "array<array<double>>"), F.lit(1.0), lambda rate, y: F.greatest(F.lit(0.0), rate - against(y)))


def fit_rates(members: DataFrame, targets: dict[str, float] = TARGETS, total: float | None = None, rounds: int = ROUNDS, within: float = 1e-7) -> Mixture:
    """members: posteriors p0, p1, ... and tokens of every document. Minimises the squared misses of the domains' expected tokens,
    each over the domain's own mass, by projected gradient from rates of 1 in the metric of the documents' tokens.

    A rate depends on its document's posterior and the steps alone, so each round is one aggregation to a row of one sum a
    domain, and no rates are stored. total: expected tokens wanted in all; unset, the least for which no domain is thinned
    out, so that documents are repeated but not dropped. A target of 0 or a domain without mass stays out of the fit.
    """
    k = len(targets)
    share = [w / sum(targets.values()) for w in targets.values()]
    p = [F.col(f"p{i}") for i in range(k)]
    sums = [F.sum(F.col("tokens") * p[i]).alias(f"s{i}") for i in range(k)]
    cross = [F.sum(F.col("tokens") * p[i] * p[j]).alias(f"c{i}_{j}") for i in range(k) for j in range(k)]
    first = members.agg(*sums, *cross).first()
    have = [first[f"s{i}"] or 0.0 for i in range(k)]
    if total is None:
        total = max([have[i] / share[i] for i in range(k) if share[i] > 0 and have[i] > 0], default=0.0)
    wanted = [total * s for s in share]
    mass = [first[f"c{i}_{i}"] or 0.0 for i in range(k)]
    live = [i for i in range(k) if mass[i] > 0]
    # The largest curvature in that metric, by power iteration; the matrix has a row and a column for each domain.
    vector, bend = [1.0] * k, 1.0
    for _ in range(100):
        new = [sum((first[f"c{i}_{j}"] or 0.0) / math.sqrt(mass[i] * mass[j]) * vector[j] for j in live) if i in live else 0.0 for i in range(k)]
        bend = math.sqrt(sum(x * x for x in new)) or 1.0
        vector = [x / bend for x in new]
    mixture = Mixture([], have, wanted)
    for _ in range(rounds):
        miss = [mixture.totals[i] - wanted[i] for i in range(k)]
        if max([abs(miss[i]) for i in live], default=0.0) <= within * max(total, 1.0):
            break
        mixture.steps.append([miss[i] / mass[i] / bend if i in live else 0.0 for i in range(k)])
        rate = mixture.rate(p)
        row = members.agg(*(F.sum(rate * F.col("tokens") * p[i]).alias(f"s{i}") for i in range(k))).first()
        mixture.totals = [row[f"s{i}"] or 0.0 for i in range(k)]
    return mixture


def fit(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, total: float | None = None, domain: str = "lang") -> tuple[DomainModel, Mixture, DataFrame]:
    """The domain model, the rates' steps, and doc_id, tokens and posteriors of all documents. The texts are read twice and never move: labelled ones for the model, all for the posteriors."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(domain).cast("string").alias("domain"), "text")
    model = fit_domains(rows, labels, tuple(targets))
    members = written(with_membership(rows.drop("domain"), model).select("doc_id", "tokens", *(f"p{k}" for k in range(len(targets)))), "membership")
    return model, fit_rates(members, targets, total), members


def _copies(rate: Column, key: Column) -> Column:
    """The rate rounded up or down by a hash of the key, so that copies add up to the rates over many documents."""
    return F.floor(rate + F.pmod(F.xxhash64(key, F.lit("copies")), F.lit(1 << 20)) / (1 << 20)).cast("int")


def rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """doc_id, domain (likeliest), membership (its posterior), tokens, rate, copies of every document.

    Null text counts as empty: it takes part with the prior and no tokens. Repeated rows stay and count; ties between
    domains go to the one named first; an empty table gives no rows; other columns are left out.
    """
    model, mixture, members = fit(docs, labels, targets)
    p = [F.col(f"p{k}") for k in range(len(model.prior))]
    found = members.withColumns({"best": F.greatest(*p) if len(p) > 1 else p[0], "rate": mixture.rate(p)})
    domain = F.coalesce(*(F.when(F.col("best") == c, F.lit(d)) for c, d in zip(p, model.prior, strict=True)))
    return found.select("doc_id", domain.alias("domain"), F.col("best").alias("membership"), F.col("tokens").cast("long").alias("tokens"), "rate", _copies(F.col("rate"), F.col("doc_id")).alias("copies"))


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """docs with every row as often as its copies say; with the total left unset that is once at least. All columns stay."""
    model, mixture, _ = fit(docs, labels, targets)
    spare = "_" * (1 + max(map(len, docs.columns)))
    found = with_membership(docs, model, spare)
    rate = F.greatest(F.lit(1.0), mixture.rate([F.col(f"{spare}p{k}") for k in range(len(model.prior))]))
    return found.withColumn(spare, F.explode(F.sequence(F.lit(1), _copies(rate, F.col("doc_id"))))).select(*docs.columns)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rates of every document, for the targets above."""
    return rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
