"""Personal data: patterns give candidate spans, weak labelers vote on them, expectation-maximisation weighs the labelers
and a span classifier trained on the resulting soft labels decides. DataFrame functions only.

Spans of the four base kinds always stay. Candidates of the further kinds are added where the classifier accepts them
and they touch no base span.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.shared import table, text_or_empty, written

MARK, OTHER = "\x01", "\x02"
BASE = ("email", "ip", "card", "phone")
ADDED = ("local_phone", "national_id", "spoken_email", "secret")
KINDS = BASE + ADDED
LABELERS = ("regex", "gazetteer", "context")
ABSTAIN = 2
# Patterns that match what the plain ones do, with possessive repeats: the time is linear in the text, and a long run needs no stack.
# An e-mail address can begin within a run of its characters only where the match before has ended (\G).
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?+[0-9]){12,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "local_phone": r"(?<![0-9A-Za-z+.)(-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[.-][0-9]{4}(?![0-9A-Za-z-])",
    "national_id": r"(?<![0-9A-Za-z.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "spoken_email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:\[at\]|\(at\)| at ) ?[A-Za-z0-9-]{1,63} ?(?:\[dot\]|\(dot\)| dot ) ?[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "secret": r"""((?i:password|passwd|token|secret|api[_-]?key)[ ]{0,3}[=:][ ]{0,3}["']?)([A-Za-z0-9+/_.-]{8,}+)""",
}
# A kind's text is searched only if it holds what no match can do without.
NEEDS = {"email": "@", "phone": "+", "ip": ".", "national_id": "-", "secret": None, "spoken_email": None, "card": None, "local_phone": None}
GAZETTEER = {
    "email": ("mail", "e-mail", "email", "contact", "write", "reach", "correo", "courriel", "kontakt", "adresse"),
    "ip": ("ip", "ipv4", "address", "addr", "host", "server", "gateway", "dns", "client", "adresse", "servidor", "serveur"),
    "card": ("card", "cards", "visa", "mastercard", "amex", "discover", "credit", "debit", "karte", "kreditkarte", "tarjeta", "carte", "pan"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "telefono", "teléfono", "téléphone", "cell", "whatsapp", "sms", "dial", "handy", "móvil", "portable"),
    "local_phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "telefono", "teléfono", "téléphone", "cell", "whatsapp", "sms", "dial", "handy", "móvil", "portable"),
    "national_id": ("ssn", "social", "security", "id", "passport", "taxpayer", "identity", "insurance", "ausweis", "dni"),
    "spoken_email": ("mail", "e-mail", "contact", "write", "reach", "correo", "courriel"),
    "secret": ("password", "passwd", "pwd", "token", "secret", "key", "bearer", "credential", "passwort", "clave", "contraseña"),
}
AGAINST = ("version", "isbn", "issn", "order", "invoice", "section", "chapter", "page")


def _pieces(text: Column, kind: str) -> Column:
    """Parts of the text, in turn between matches and matched."""
    marked = F.regexp_replace(F.translate(text, MARK, OTHER), PATTERNS[kind], f"$1{MARK}$2{MARK}" if kind == "secret" else f"{MARK}$0{MARK}")
    return F.split(marked, MARK)


def _holds(kind: str, match: Column) -> Column:
    """Whether a match passes its kind's test."""
    if kind == "ip":
        return ~match.rlike(r"(^|\.)0*(2(5[6-9]|[6-9][0-9])|[3-9][0-9]{2}|[1-9][0-9]{3,})(\.|$)")
    if kind == "phone":
        return F.length(F.regexp_replace(match, "[^0-9]", "")).between(9, 15)
    if kind == "card":
        digits = F.regexp_replace(match, "[ -]", "")
        n = F.length(digits)
        total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + _luhn(F.substring(digits, n - i + 1, F.lit(1)).cast("int"), i))
        return F.when(n.between(13, 19), total % 10 == 0).otherwise(False)
    return F.lit(True)


def _luhn(digit: Column, place: Column) -> Column:
    twice = digit * 2
    return F.when(place % 2 == 1, digit).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))


_FIELDS = "struct<kind:string,start:long,end:long,text:string,before:string,after:string>"
_SPAN = f"array<{_FIELDS}>"
BLOCK, CUT = 64, 1024


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once: what stands in a lambda is worked out at each of its calls."""
    return F.get(F.transform(F.array(value), body), 0)


def _scan(items: Column, carry: Column, found: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """All that step(carry, item) finds, for one item after another; it gives the next carry and an array. found: the type of the arrays.

    An array grows by a copy, so items go by blocks: first the carry at the start of each is found, then what each block finds is gathered.
    """
    none = F.array().cast(found)

    def each(held: Column, item: Column) -> Column:
        now, made = step(held["carry"], item)
        return F.struct(now.alias("carry"), F.concat(held["found"], made).alias("found"))

    def over(given: Column) -> Column:
        of = lambda b: F.slice(given, b * BLOCK + 1, F.lit(BLOCK))
        blocks = F.sequence(F.lit(0), F.floor((F.size(given) - 1) / BLOCK).cast("int"))
        carries = lambda held, b: F.array_append(held, F.aggregate(of(b), F.element_at(held, -1), lambda c, item: step(c, item)[0]))
        gathered = lambda starts: F.flatten(F.transform(blocks, lambda b: F.aggregate(of(b), F.struct(F.get(starts, b).alias("carry"), none.alias("found")), each, lambda h: h["found"])))
        return F.when(F.size(given) > 0, _bound(F.aggregate(blocks, F.array(carry), carries), gathered)).otherwise(none)

    return _bound(items, over)


def _spans(pieces: Column, kind: str) -> Column:
    """kind, start, end (code points, end exclusive), matched text and what stands around it, in order."""

    def step(place: Column, i: Column) -> tuple[Column, Column]:
        piece = F.get(pieces, i)
        end = place + F.length(piece)
        span = F.struct(
            F.lit(kind).alias("kind"), place.alias("start"), end.alias("end"), piece.alias("text"),
            F.lower(F.right(F.get(pieces, i - 1), F.lit(24))).alias("before"), F.left(F.get(pieces, i + 1), F.lit(4)).alias("after"),
        )
        return end, F.when((i % 2 == 1) & _holds(kind, piece), F.array(span)).otherwise(F.array().cast(_SPAN))

    some = _scan(F.sequence(F.lit(0), F.size(pieces) - 1), F.lit(0).cast("long"), _SPAN, step)
    return F.when(F.size(pieces) > 1, some).otherwise(F.array().cast(_SPAN))


def _apart(more: Column, base: Column) -> Column:
    """The spans of more that touch none of base: one scan by start holds each against the furthest end before it, one backward against the next start."""
    item = lambda added: lambda s: F.struct(s["start"].alias("start"), F.lit(added).alias("added"), s["end"].alias("end"), s.alias("span"))
    kind = f"array<struct<start:long,added:int,end:long,span:{_FIELDS}>>"
    none = F.array().cast(kind)

    def ahead(furthest: Column, s: Column) -> tuple[Column, Column]:
        return F.when(s["added"] == 0, F.greatest(furthest, s["end"])).otherwise(furthest), F.when((s["added"] == 1) & (furthest <= s["start"]), F.array(s)).otherwise(none)

    def back(following: Column, s: Column) -> tuple[Column, Column]:
        return F.when(s["added"] == 0, s["start"]).otherwise(following), F.when((s["added"] == 1) & (following >= s["end"]), F.array(s)).otherwise(none)

    bases = F.transform(base, item(0))
    free = _scan(F.array_sort(F.concat(bases, F.transform(more, item(1)))), F.lit(-1).cast("long"), kind, ahead)
    free = _scan(F.reverse(F.array_sort(F.concat(bases, free))), F.lit((1 << 62)).cast("long"), kind, back)
    spans = F.reverse(F.transform(free, lambda s: s["span"]))
    of = lambda kind: lambda s: s["kind"] == kind
    return F.concat(*(F.filter(spans, of(k)) for k in ADDED))


def candidates(docs: DataFrame, own: str = "") -> DataFrame:
    """docs, text null: empty, with base and more, each behind the prefix own: the candidate spans of the base kinds and of the further ones.

    Matches are found on the whole text by one pass a kind, in time that grows with the text and its matches. A row keeps all its columns; repeated rows stay.
    """
    text = text_or_empty()
    out = docs.withColumn("text", text)
    for kind in KINDS:
        wanted = F.contains(F.col("text"), F.lit(NEEDS[kind])) if NEEDS[kind] else F.col("text").rlike("[=:]") if kind == "secret" else F.col("text").rlike("[0-9]") if kind in ("card", "local_phone") else F.col("text").rlike(r"(?:\[at\]|\(at\)| at ).{0,80}(?:\[dot\]|\(dot\)| dot )")
        out = out.withColumn(f"{own}_pieces_{kind}", F.when(wanted, _pieces(F.col("text"), kind)).otherwise(F.array(F.lit(""))))
    for kind in KINDS:
        out = out.withColumn(f"{own}_spans_{kind}", _spans(F.col(f"{own}_pieces_{kind}"), kind))
    out = out.withColumn(f"{own}base", F.concat(*(F.col(f"{own}_spans_{k}") for k in BASE)))
    out = out.withColumn(f"{own}_all", F.concat(*(F.col(f"{own}_spans_{k}") for k in ADDED)))
    all_, base = F.col(f"{own}_all"), F.col(f"{own}base")
    out = out.withColumn(f"{own}more", F.when((F.size(all_) > 0) & (F.size(base) > 0), _apart(all_, base)).otherwise(all_))
    return out.drop(f"{own}_all", *(f"{own}_{w}_{k}" for w in ("pieces", "spans") for k in KINDS))


def _regex_vote(s: Column) -> Column:
    strict = {
        "email": r"^[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9.-]*\.[A-Za-z]{2,24}$",
        "ip": r"^(?!0+\.)(?![0-9](\.[0-9]){3}$)",
        "card": r"^(4|5[1-5]|2[2-7]|3[47]|6)",
        "phone": r"^\+[1-9]([^0-9]*[0-9]){9,12}$",
        "local_phone": r"^\(?[2-9][0-9]{2}",
        "national_id": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)",
        "spoken_email": r"(?i)(com|org|net|edu|gov|io|de|fr|es|info)$",
        "secret": r"^(?=.{0,200}[0-9])(?=.{0,200}[A-Za-z]).{12,}$",
    }
    return reduce(lambda otherwise, k: F.when(s["kind"] == k, s["text"].rlike(strict[k]).cast("int")).otherwise(otherwise), strict, F.lit(ABSTAIN))


def _gazetteer_vote(s: Column) -> Column:
    def near(words: tuple[str, ...]) -> Column:
        return s["before"].rlike(r"(?<![a-z])(?:" + "|".join(words) + r")(?![a-z])")

    listed = reduce(lambda otherwise, k: F.when(s["kind"] == k, near(GAZETTEER[k])).otherwise(otherwise), KINDS, F.lit(False))
    return F.when(listed, 1).when(near(AGAINST), 0).otherwise(ABSTAIN)


def _context_vote(s: Column) -> Column:
    apart = (s["before"] == "") | s["before"].rlike(r"[\s\"'(\[<=:]$")
    free = (s["after"] == "") | s["after"].rlike(r"^[\s\"')\]>.,;:!?]")
    return (apart & free).cast("int")


def votes(s: Column) -> Column:
    """What a span shows the classifier: its kind, the three votes and classes of its length and its share of digits."""
    digits = F.length(F.regexp_replace(s["text"], "[^0-9]", ""))
    return F.struct(
        s["kind"].alias("kind"), _regex_vote(s).alias("regex"), _gazetteer_vote(s).alias("gazetteer"), _context_vote(s).alias("context"),
        F.when(F.length(s["text"]) < 12, 0).when(F.length(s["text"]) < 24, 1).otherwise(2).alias("size"),
        F.when(digits * 4 < F.length(s["text"]), 0).when(digits * 4 < 3 * F.length(s["text"]), 1).otherwise(2).alias("digits"),
    )


@dataclass
class SpanModel:
    """reliability[labeler][truth][vote], and the weight of each indicator of the final classifier."""

    prior: float
    reliability: dict[str, list[list[float]]]
    weights: dict[tuple[str, object], float]

    def probability(self, shown: Column) -> Column:
        z = F.lit(self.weights.get(("bias", 0), 0.0))
        for (name, value), w in sorted(self.weights.items(), key=str):
            if name != "bias":
                z = z + F.when(shown[name] == value, w).otherwise(0.0)
        return 1 / (1 + F.exp(-z))


def fit_patterns(patterns: list[tuple[dict, int]], rounds: int = 40, steps: int = 300, rate: float = 1.0) -> SpanModel:
    """From each combination of votes and classes, and how often it occurs: the labelers' reliabilities by
    expectation-maximisation, then a logistic span classifier on the posteriors."""
    total = sum(n for _, n in patterns) or 1
    posterior = []
    for p, _ in patterns:
        cast = [p[k] for k in LABELERS if p[k] != ABSTAIN]
        posterior.append((1 + 2 * sum(cast)) / (2 + 2 * len(cast)))
    prior, reliability = 0.5, {k: [[1 / 3] * 3, [1 / 3] * 3] for k in LABELERS}
    for _ in range(rounds):
        prior = min(max(sum(q * n for q, (_, n) in zip(posterior, patterns, strict=True)) / total, 0.02), 0.98)
        for k in LABELERS:
            # One pseudo-vote for each outcome, and more where the labeler is better than chance: truth 1 stays the class that votes of 1 speak for.
            table_ = [[4.0, 1.0, 1.0], [1.0, 4.0, 1.0]]
            for q, (p, n) in zip(posterior, patterns, strict=True):
                table_[1][p[k]] += q * n
                table_[0][p[k]] += (1 - q) * n
            reliability[k] = [[x / sum(row) for x in row] for row in table_]
        for i, (p, _) in enumerate(patterns):
            odds = math.log(prior / (1 - prior)) + sum(math.log(reliability[k][1][p[k]] / reliability[k][0][p[k]]) for k in LABELERS)
            posterior[i] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    shown = [[("bias", 0), *p.items()] for p, _ in patterns]
    weights: dict[tuple[str, object], float] = {f: 0.0 for fs in shown for f in fs}
    for _ in range(steps):
        slope = {f: -1e-3 * w for f, w in weights.items()}
        for fs, q, (_, n) in zip(shown, posterior, patterns, strict=True):
            z = max(-30.0, min(30.0, sum(weights[f] for f in fs)))
            miss = (q - 1 / (1 + math.exp(-z))) * n / total
            for f in fs:
                slope[f] += miss
        for f, s in slope.items():
            weights[f] += rate * s
    return SpanModel(prior, reliability, weights)


def fit(spans: DataFrame, own: str = "") -> SpanModel:
    """The model from all candidate spans. Only their counts by votes and classes reach the driver: at most
    8 kinds x 27 votes x 9 classes of rows, however large the corpus is."""
    shown = spans.select(F.explode(F.concat(f"{own}base", f"{own}more")).alias("s")).select(votes(F.col("s")).alias("v"))
    counted = shown.groupBy("v.kind", *(f"v.{k}" for k in LABELERS), "v.size", "v.digits").count()
    rows = [r.asDict() for r in counted.collect()]
    patterns = sorted(((({k: v for k, v in r.items() if k != "count"}), r["count"]) for r in rows), key=str)
    return fit_patterns(patterns)


def with_found(spans: DataFrame, model: SpanModel, own: str = "") -> DataFrame:
    """found: the base spans, and the further ones that the classifier accepts, by kind and start."""
    accepted = F.filter(f"{own}more", lambda s: model.probability(votes(s)) >= 0.5)
    return spans.withColumn(f"{own}found", F.concat(f"{own}base", accepted))


def find(docs: DataFrame, keep: str = "doc_id") -> DataFrame:
    """The column named, base and found spans of every document.

    Null text counts as empty and has no spans; an empty table gives no rows; repeated rows stay; other columns are
    left out, whatever their names. The candidates are written once and serve both the fit and the result.
    """
    spans = written(candidates(docs.select(keep, "text")).select(keep, "base", "more"), "spans")
    return with_found(spans, fit(spans))


def _cut(blocks: Column, start: Column, end: Column) -> Column:
    """The text from start to end, of blocks of CUT code points each."""
    first, last = F.floor(start / CUT).cast("int"), F.floor((end - 1) / CUT).cast("int")
    offset = (start % CUT + 1).cast("int")
    across = F.concat(
        F.substring(F.get(blocks, first), offset, F.lit(CUT)), F.array_join(F.slice(blocks, first + 2, last - first - 1), ""),
        F.substring(F.get(blocks, last), F.lit(1), ((end - 1) % CUT + 1).cast("int")),
    )
    return F.when(start >= end, F.lit("")).when(first == last, F.substring(F.get(blocks, first), offset, (end - start).cast("int"))).otherwise(across)


def redacted(docs: DataFrame) -> DataFrame:
    """docs with each found span replaced by its kind in brackets; overlapping spans go as one. Columns stay as they are, whatever their names."""
    columns = docs.columns
    model = fit(candidates(docs.select("text")))
    own = "_"
    while any(c.lower().startswith(own) for c in columns):
        own += "_"
    out = with_found(candidates(docs, own), model, own).withColumn(f"{own}blocks", F.when(F.size(f"{own}found") > 0, F.regexp_extract_all("text", F.lit(f"(?s).{{1,{CUT}}}"), F.lit(0))))
    found, blocks = F.col(f"{own}found"), F.col(f"{own}blocks")
    ordered = F.array_sort(F.transform(found, lambda s: F.struct(s["start"], s["end"], s["kind"])))

    def step(place: Column, s: Column) -> tuple[Column, Column]:
        fresh = F.array(_cut(blocks, place, s["start"]), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        return F.greatest(place, s["end"]), F.when(s["start"] >= place, fresh).otherwise(F.array().cast("array<string>"))

    last = F.array_max(F.transform(found, lambda s: s["end"]))
    clean = F.concat(F.array_join(_scan(ordered, F.lit(0).cast("long"), "array<string>", step), ""), _cut(blocks, last, F.length("text").cast("long")))
    return out.withColumn("text", F.when(F.size(found) > 0, clean).otherwise(F.col("text"))).select(*columns)


def _listed(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _count(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query over every document."""
    found = find(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *map(_count, BASE), F.sha2(_listed("base").cast("binary"), 256).alias("base_sha256"), _listed("found").alias("spans"), F.size("found").cast("long").alias("n_spans"))
