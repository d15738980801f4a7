"""Name keys. Unicode normalisation is the one thing Spark has no built-in for, so it is
the one Arrow UDF of the package, and plain ASCII text is not sent to it."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Spelling variants of area names that are not a matter of case or blanks.
NAME_ALIASES = {
    "århus": "aarhus",
    "vesthimmerland": "vesthimmerlands",
    "nordfyn": "nordfyns",
    "lyngby-tårbæk": "lyngby-taarbæk",
    "brønderslev-dronninglund": "brønderslev",
    "høje taastrup": "høje-taastrup",
    "københavns": "københavn",
    "faaborg-midtfyn": "faaborg-midtfyn",
}


def _normaliser(form: str):
    @F.pandas_udf("string")
    def normalise(s: pd.Series) -> pd.Series:
        return s.map(lambda t: unicodedata.normalize(form, t), na_action="ignore")

    return normalise


def with_unicode_form(df: DataFrame, source: str, target: str, form: str = "NFC") -> DataFrame:
    """``target`` holds ``source`` in the given Unicode form.

    Plain ASCII text is its own normal form, so it goes to the Python side as a null and
    costs next to nothing there; no shuffle is involved.
    """
    odd = F.when(F.col(source).rlike(r"[^\x00-\x7F]"), F.col(source))
    return df.withColumn(target, F.coalesce(_normaliser(form)(odd), F.col(source)))


# What a stop's name loses before names are compared. Keys must come out the same for the same stops.
STOP_BRACKETS = r"(\s*\([^)]*\))+\s*$"
STOP_SUFFIX = r"(?i)\s+(st\.?|station)$"
STOP_MARKS = "[.,'`´’]"


def stop_name_key(x: Column) -> Column:
    """Grouping key of stop names (input already in composed form): trailing brackets and
    a final ``St.``/``station`` go, punctuation goes, case and blanks are folded."""
    s = F.trim(F.coalesce(x, F.lit("")))
    s = F.trim(F.regexp_replace(s, STOP_BRACKETS, ""))
    s = F.trim(F.regexp_replace(s, STOP_SUFFIX, ""))
    s = F.regexp_replace(s, STOP_MARKS, "")
    return F.regexp_replace(F.lower(s), r"\s+", " ")


def display_name(x: Column) -> Column:
    """The spelling shown for a stop: one trailing bracket dropped."""
    return F.trim(F.regexp_replace(F.trim(x), r"\s*\([^)]*\)\s*$", ""))


def area_name_key(x: Column, aliases: dict[str, str] | None = None) -> Column:
    """Join key of area names (input already in compatibility form)."""
    s = F.lower(F.trim(x))
    s = F.regexp_replace(F.regexp_replace(s, r"\s+kommune$", ""), r"\s+", " ")
    table = NAME_ALIASES if aliases is None else aliases
    if not table:
        return s
    lookup = F.create_map(*[F.lit(v) for kv in table.items() for v in kv])
    return F.coalesce(F.element_at(lookup, s), s)


def all_words(query: str, *fields: Column) -> Column:
    """Every word of the query occurs somewhere in the joined fields."""
    blob = F.lower(F.concat_ws(" ", *fields))
    test = F.lit(True)
    for w in query.lower().split():
        test = test & F.contains(blob, F.lit(w))
    return test


def match_rank(query: str, *fields: Column) -> Column:
    """0 exact, 1 prefix, 2 contained, null otherwise; best over the fields."""
    q = query.lower().strip()
    ranks = [
        F.when(F.lower(f) == q, 0).when(F.startswith(F.lower(f), F.lit(q)), 1)
        .when(F.contains(F.lower(f), F.lit(q)), 2)
        for f in fields
    ]
    return F.least(*ranks) if len(ranks) > 1 else ranks[0]
