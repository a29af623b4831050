"""Names and descriptions as column expressions."""

from __future__ import annotations

import unicodedata
from itertools import chain

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.functions import vocab


@F.pandas_udf(T.StringType())
def decomposed_ascii(v: pd.Series) -> pd.Series:
    """Compatibility decomposition without what isn't ASCII; Spark has no function for it."""
    return v.map(lambda s: None if s is None else unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode())


#: Letters, by code point below 0x3000, whose compatibility decomposition leaves one ASCII character.
_LETTERS = [(chr(i), a) for i in range(0x80, 0x3000) if len(a := unicodedata.normalize("NFKD", chr(i)).encode("ascii", "ignore").decode()) == 1]


def plain_letters(v: Column) -> Column:
    """v without marks and without what isn't ASCII after that. In the JVM: only characters that stand for several letters (ligatures, fractions) differ from
    decomposed_ascii, as these go."""
    return F.regexp_replace(F.translate(v, "".join(c for c, _ in _LETTERS), "".join(a for _, a in _LETTERS)), r"[^\x00-\x7F]", "")


def ascii_slug(v: Column) -> Column:
    """Slug of a text that is ASCII already; anything else counts as a separator."""
    s = F.regexp_replace(F.regexp_replace(F.lower(v), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(s == "", "poi").otherwise(s)


def slug(v: Column) -> Column:
    return ascii_slug(decomposed_ascii(v))


def clean(v: Column) -> Column:
    """Trimmed; null if nothing is left."""
    return F.nullif(F.trim(v), F.lit(""))


def first_present(*vs: Column) -> Column:
    return F.coalesce(*map(clean, vs))


def has_any(v: Column, words: tuple[str, ...]) -> Column:
    """Whether a lower-cased text contains any of the words, as parts of words too."""
    out = F.lit(False)
    for w in words:
        out = out | v.contains(w)
    return F.coalesce(out, F.lit(False))


def name_words(v: Column) -> Column:
    """Distinct words of a name for likeness: plural s off words of five letters and more, then without stop words."""
    words = F.split(ascii_slug(plain_letters(v)), "-")
    short = F.transform(words, lambda w: F.when((F.length(w) > 4) & w.endswith("s"), F.regexp_replace(w, "s$", "")).otherwise(w))
    return F.array_distinct(F.filter(short, lambda w: ~w.isin(*vocab.NAME_STOP_WORDS) & (w != "")))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all words; 0 if either has none."""
    either = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / either)


def historic_name(v: Column, relaxed: bool = False) -> Column:
    """A register name in a form that can be compared: words unified, filler dropped."""
    plain = F.replace(F.regexp_replace(F.lower(v), "[’']s\\b", "s"), F.lit("&"), F.lit(" and "))
    words = F.split(ascii_slug(plain_letters(plain)), "-")
    same = F.create_map(*chain.from_iterable((F.lit(k), F.lit(w)) for k, w in vocab.SAME_WORDS.items()))
    words = F.transform(words, lambda w: F.coalesce(same[w], w))
    drop = vocab.DROP_WORDS + (vocab.RELAXED_DROP_WORDS if relaxed else ())
    return F.array_join(F.filter(words, lambda w: ~w.isin(*drop) & (w != "")), " ")


def historic_forms(v: Column) -> Column:
    return F.array_distinct(F.filter(F.array(historic_name(v), historic_name(v, relaxed=True)), lambda f: f != ""))


def poor_description(v: Column) -> Column:
    """Null, short, a survey note, or a bare list."""
    flat = F.trim(F.regexp_replace(v, r"\s+", " "))
    commas = F.length(flat) - F.length(F.replace(flat, F.lit(","), F.lit("")))
    poor = (F.length(flat) < 20) | has_any(F.lower(flat), vocab.LOW_SIGNAL) | ((commas >= 3) & (F.size(F.split(flat, " ")) <= 8))
    return F.coalesce(poor, F.lit(True))


def type_template(kind: Column) -> Column:
    templates = F.create_map(*chain.from_iterable((F.lit(k), F.lit(t[1])) for k, t in vocab.TYPES.items()))
    return F.coalesce(templates[kind], F.lit(vocab.NO_DESCRIPTION))


def short_description(override: Column, stored: Column, kind: Column) -> Column:
    """The first good one of the override, what is stored, and the type's template."""
    return F.coalesce(F.when(~poor_description(override), override), F.when(~poor_description(stored), stored), type_template(kind))


def description_quality(stored: Column, kind: Column) -> Column:
    chosen = short_description(F.lit(None).cast("string"), stored, kind)
    return F.when(chosen == vocab.NO_DESCRIPTION, 0.0).otherwise(F.least(F.length(chosen) / 20.0, F.lit(10.0)))
