"""Per-key results and joins that stay balanced when a few keys hold most rows.

Heavy keys are found with a mergeable frequent-items sketch (one pass, no shuffle of the keys), confirmed by an exact
count, and then treated apart: a broadcast table of the confirmed keys, whose number is bounded by ``1 / support`` times
the keys of a row, marks their rows; these are spread over salts. All other keys take an ordinary shuffle. Both results
are put together with a union, so no row is dropped, capped or sampled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The sketch's error as a share of the stream is at most ``SKETCH_ERROR / items tracked``.
SKETCH_ERROR = 3.5
MIN_TRACKED, MAX_TRACKED = 1024, 1_000_000


def sketch_candidates(df: DataFrame, keys: list[str], least: float) -> DataFrame:
    """A superset of the key tuples that have at least ``least`` rows in ``df``, at most about ``2 / share`` of them.

    The sketch is widened until its error is below half of ``least``, so no frequent key is missed. Null keys count as
    keys. An empty frame, or ``least`` too low for any sketch, is answered from exact counts.
    """
    n, tracked = df.count(), MIN_TRACKED
    if n and least > 0:
        tracked = max(MIN_TRACKED, 2 ** math.ceil(math.log2(4 * SKETCH_ERROR * n / least)))
    if not n or least <= 0 or tracked > MAX_TRACKED:
        return df.groupBy(*keys).count().where(F.col("count") >= least).select(*keys)
    k = min(tracked, 2 * math.ceil(n / least) + 1)
    packed = df.select(F.struct(*keys).alias("_k")) if len(keys) > 1 else df.select(F.col(keys[0]).alias("_k"))
    if len(keys) > 1:
        packed = packed.select(F.to_json("_k", {"ignoreNullFields": "false"}).alias("_k"))
    top = packed.agg(F.expr(f"approx_top_k(_k, {k}, {tracked})").alias("top")).select(F.explode("top").alias("t"))
    if len(keys) == 1:
        return top.select(F.col("t.item").alias(keys[0]))
    schema = df.select(*keys).schema
    return top.select(F.from_json(F.col("t.item"), schema).alias("s")).select("s.*")


def heavy_hitters(df: DataFrame, keys: list[str], least: float) -> DataFrame:
    """Every key tuple with at least ``least`` rows, and its exact ``n_rows``. Null key parts never qualify.

    Sketch first, then an exact count of the few candidates: their rows are picked by a broadcast semi-join and counted
    with map-side combination, so a hot key costs one partial row per task.
    """
    known = df.dropna(subset=keys)
    candidates = F.broadcast(sketch_candidates(known, keys, least).distinct())
    counted = known.join(candidates, keys, "left_semi").groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    return counted.where(F.col("n_rows") >= F.lit(float(least)))


def skew_aggregate(
    df: DataFrame, keys: list[str], heavy: DataFrame, sums: dict[str, Column], distinct: str, name: str, salts: int = 64
) -> DataFrame:
    """Groups by ``keys`` with the sums of ``sums`` and, as ``name``, the number of distinct non-null ``distinct`` values.

    ``heavy`` has the key tuples to treat apart (a bounded table, broadcast). Rows of heavy keys are salted by the value
    that is counted, so the salts of a key hold disjoint values and their counts add up. Other keys shuffle once by key.
    """
    mark = F.broadcast(heavy.select(*keys).distinct().withColumn("_hot", F.lit(True)))
    marked = df.join(mark, keys, "left")
    once = [F.sum(c).alias(n) for n, c in sums.items()]
    light = marked.where(F.col("_hot").isNull()).groupBy(*keys).agg(*once, F.count_distinct(distinct).alias(name))
    salt = F.pmod(F.xxhash64(distinct), F.lit(salts)).alias("_salt")
    hot = marked.where(F.col("_hot")).groupBy(*keys, salt).agg(*once, F.count_distinct(distinct).alias(name))
    return light.unionByName(hot.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in [*sums, name]]))


def skew_join(left: DataFrame, lookup: DataFrame, key: str, heavy: DataFrame, how: str = "left") -> DataFrame:
    """Joins ``left`` to ``lookup``, which has at most one row for each ``key``; the keys of ``heavy`` don't shuffle.

    Rows of heavy keys meet a broadcast of their lookup rows (as many as heavy keys, so bounded), the rest shuffles as
    usual. ``how`` is ``left`` or ``inner``. Null keys stay in a left join, unmatched.
    """
    if how not in ("left", "inner"):
        raise ValueError("how must be left or inner")
    hot_keys = F.broadcast(heavy.select(key).distinct())
    hot_rows = F.broadcast(lookup.join(hot_keys, key, "left_semi"))
    light = left.join(hot_keys, key, "left_anti").join(lookup, key, how)
    hot = left.join(hot_keys, key, "left_semi").join(hot_rows, key, how)
    return light.unionByName(hot)
