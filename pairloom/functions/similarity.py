"""Similarity of two entities: best name ratio, overlaps, and the weighted score of the deterministic matcher."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from pairloom.functions.text import normalize_text, prop, token_key, years

# Weights of the score.
NAME_WEIGHT, COUNTRY_BONUS, DATE_BONUS, YEAR_BONUS = 0.7, 0.1, 0.2, 0.1


@F.pandas_udf(DoubleType())
def _best_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Largest matching-blocks ratio of any pair of keys, from left to right, as the ratio isn't symmetric."""
    from difflib import SequenceMatcher

    known: dict[tuple[str, str], float] = {}

    def ratio(a: str, b: str) -> float:
        if (a, b) not in known:
            known[a, b] = SequenceMatcher(None, a, b).ratio()
        return known[a, b]

    def best(xs, ys) -> float | None:
        return None if xs is None or ys is None else max((ratio(x, y) for x in xs for y in ys), default=0.0)

    return pd.Series([best(x, y) for x, y in zip(left, right, strict=True)], dtype="float64")


def name_keys(names: Column) -> Column:
    """The distinct sorted-word keys of an array of names."""
    return F.array_distinct(F.transform(names, token_key))


def name_similarity(left: Column, right: Column) -> Column:
    """Best ratio between two arrays of names, compared as sorted words; 0 if either is empty."""
    return key_similarity(name_keys(left), name_keys(right))


def key_similarity(l: Column, r: Column) -> Column:
    """The same from two arrays of keys; better given as columns, as they are used several times.

    Equal keys are settled in the JVM; only the other pairs go to Python, as arrays, so nothing is shuffled.
    """
    easy = F.arrays_overlap(l, r) | (F.size(l) == 0) | (F.size(r) == 0)
    hard = lambda c: F.when(~easy, c)
    return F.when(F.arrays_overlap(l, r), 1.0).otherwise(F.coalesce(_best_ratio(hard(l), hard(r)), F.lit(0.0)))


def values_overlap(left: Column, right: Column) -> Column:
    """Whether two arrays share a normal form; blank values match blank ones."""
    norm = lambda c: F.transform(c, normalize_text)
    return F.arrays_overlap(norm(left), norm(right))


def score(name: Column, left: str = "left", right: str = "right") -> Column:
    """The weighted score from a name similarity; doubles are added in a fixed order, so 0.7 + 0.1 stays below 0.8."""
    countries = lambda e: F.concat(prop(e, "country"), prop(e, "nationality"))
    dates = prop(left, "birthDate"), prop(right, "birthDate")
    same_date = values_overlap(*dates)
    same_year = values_overlap(years(dates[0]), years(dates[1]))
    s = name * F.lit(NAME_WEIGHT)
    s = s + F.when(values_overlap(countries(left), countries(right)), F.lit(COUNTRY_BONUS)).otherwise(0.0)
    s = s + F.when(same_date, F.lit(DATE_BONUS)).when(same_year, F.lit(YEAR_BONUS)).otherwise(0.0)
    return F.least(F.lit(1.0), s)


def similarity_score(left: str = "left", right: str = "right") -> Column:
    """Score of two entity columns: names by ratio, bonuses for a shared country or nationality and birth date or year."""
    return score(name_similarity(prop(left, "name"), prop(right, "name")), left, right)


def shared_fields(left: str = "left", right: str = "right") -> Column:
    """The properties of both entities that share a value."""
    p = lambda e: F.coalesce(F.col(f"{e}.properties"), F.create_map().cast("map<string,array<string>>"))
    return F.filter(F.map_keys(p(left)), lambda k: F.coalesce(F.arrays_overlap(F.try_element_at(p(left), k), F.try_element_at(p(right), k)), F.lit(False)))
