"""Profiles of the pair table: distributions, concentration, lengths, completeness, combinations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def describe(df: DataFrame, value: str, *by: str) -> DataFrame:
    """``n, mean, median, p25, p75, max, min`` with quartiles taken by index, ``sorted[n // 4]`` and ``sorted[3 n // 4]``.

    Works on counts of distinct values, so only those are sorted. Nulls are left out; no rows give no row.
    """
    h = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("m"))
    upto = W.partitionBy(*by).orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    c = h.withColumns({"upto": F.sum("m").over(upto), "n": F.sum("m").over(W.partitionBy(*by))})

    def at(i: Column) -> Column:
        """The value at 0-based index i of all rows in order."""
        return F.min(F.when(F.col("upto") > i, F.col("v")))

    n = F.col("n")
    middle = (at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2
    return c.groupBy(*by).agg(
        F.max("n").alias("n"), (F.sum(F.col("v") * F.col("m")) / F.max("n")).alias("mean"), middle.alias("median"),
        at(F.floor(n / 4)).alias("p25"), at(F.least(n - 1, F.floor(n * 3 / 4))).alias("p75"), F.max("v").alias("max"), F.min("v").alias("min"),
    )


def gini(counts: DataFrame, count: str) -> DataFrame:
    """``gini`` of non-negative counts; 0 for none or only zeros. Equal counts are one row of the ranking."""
    h = counts.groupBy(F.col(count).cast("double").alias("x")).agg(F.count(F.lit(1)).alias("m"))
    before = F.coalesce(F.sum("m").over(W.orderBy("x").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    h = h.withColumn("ix", F.col("x") * (F.col("m") * before + F.col("m") * (F.col("m") + 1) / 2))
    s, n = F.sum(F.col("x") * F.col("m")), F.sum("m")
    return h.agg(F.coalesce(F.try_divide(F.lit(2.0) * F.sum("ix"), n * s) - F.try_divide((n + 1).cast("double"), n), F.lit(0.0)).alias("gini"))


def shares(df: DataFrame, *by: str) -> DataFrame:
    """Counts and their share of all rows."""
    c = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy()))


def combos(df: DataFrame, left: Column, right: Column, positive: Column, name: str) -> DataFrame:
    """Counts of unordered pairs of values, in all and by label."""
    key = F.array_join(F.array_sort(F.array(left, right)), "|").alias(name)
    return df.select(key, positive.alias("p")).groupBy(name).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("p").alias("n_positive"), F.count_if(~F.col("p")).alias("n_other")
    )


def cross_source(left: Column, right: Column) -> Column:
    """Both arrays have values and share none; an empty side counts as the same source."""
    l, r = (F.coalesce(c, F.array().cast("array<string>")) for c in (left, right))
    return (F.size(l) > 0) & (F.size(r) > 0) & ~F.coalesce(F.arrays_overlap(l, r), F.lit(False))


def field_values(pairs: DataFrame) -> DataFrame:
    """``side, field, value`` for every value of every property on both sides, repeated ones kept."""
    both = pairs.select(F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"{s}.properties").alias("p")) for s in ("left", "right")])).alias("x"))
    fields = both.select("x.side", F.explode("x.p").alias("field", "vs"))
    return fields.select("side", "field", F.explode("vs").alias("value"))


def completeness(pairs: DataFrame) -> DataFrame:
    """``field, left_share, right_share, mean_share``: sides with a non-empty property, as shares of all pairs."""
    n = pairs.count()
    both = pairs.select(F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"{s}.properties").alias("p")) for s in ("left", "right")])).alias("x"))
    f = both.select("x.side", F.explode("x.p").alias("field", "vs"))
    some = F.size("vs") > 0
    per = f.groupBy("field").agg(F.count_if(some & (F.col("side") == "left")).alias("l"), F.count_if(some & (F.col("side") == "right")).alias("r"))
    share = lambda c: F.col(c) / F.lit(float(max(n, 1)))
    return per.select("field", share("l").alias("left_share"), share("r").alias("right_share"), ((F.col("l") + F.col("r")) / F.lit(2.0 * max(n, 1))).alias("mean_share"))
