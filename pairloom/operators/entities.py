"""Relations derived from the pair table: sides, ids, first-seen entities, incidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def positive(judgement: Column) -> Column:
    """True where the judgement reads ``positive`` without surrounding blanks and case; null counts as false."""
    return F.coalesce(F.lower(F.regexp_replace(judgement, r"(?U)^\s+|\s+$", "")) == "positive", F.lit(False))


def real_id(c: Column) -> Column:
    """The id, or null where it is null or empty."""
    return F.when(c != "", c)


def sides(pairs: DataFrame, *extra: str) -> DataFrame:
    """One row per side: ``pair_id``, ``side`` (0 left, 1 right), ``e`` (the entity) and the columns of ``extra``."""
    both = pairs.select("pair_id", *extra, F.posexplode(F.array("left", "right")).alias("side", "e"))
    return both


def pair_ids(pairs: DataFrame) -> DataFrame:
    """``pair_id``, ``lid``, ``rid`` (null where missing or empty) and ``positive``: all that graph operators read."""
    return pairs.select(
        "pair_id",
        real_id(F.col("left.id")).alias("lid"),
        real_id(F.col("right.id")).alias("rid"),
        positive(F.col("judgement")).alias("positive"),
    )


def first_seen(pairs: DataFrame) -> DataFrame:
    """The first occurrence of each id by pair and side, left first; later, richer copies are ignored.

    ``min_by`` combines on the map side, so an id in a third of all rows costs one row per task, unlike a window.
    """
    s = sides(pairs).where(F.col("e.id").isNotNull() & (F.col("e.id") != ""))
    return s.groupBy(F.col("e.id").alias("id")).agg(F.min_by("e", F.struct("pair_id", "side")).alias("e")).select("id", "e")


def incidence(pairs: DataFrame) -> DataFrame:
    """The pair graph's incidence: one row per distinct ``id`` and ``pair_id``, flat, so a hot id never becomes one array."""
    p = pair_ids(pairs)
    return p.select("pair_id", F.explode(F.array_distinct(F.array("lid", "rid"))).alias("id")).dropna(subset=["id"])


def key_events(pairs: DataFrame) -> DataFrame:
    """One row per pair, field and key: ``field`` (``datasets`` or ``id``), ``key``, ``pair_id``, ``positive``, ``partner``.

    A pair counts once for a key, whichever sides have it; ``first`` is 1 on exactly one of its rows. ``partner`` is the
    id of the side opposite to the key, null where that is missing. Blank dataset names and missing ids give no key.
    """

    def keyed(field: str, left: Column, right: Column) -> DataFrame:
        rows = pairs.select(
            "pair_id",
            positive(F.col("judgement")).alias("positive"),
            left.alias("l"),
            right.alias("r"),
            real_id(F.col("left.id")).alias("lid"),
            real_id(F.col("right.id")).alias("rid"),
        )
        k = rows.select("*", F.explode(F.array_union("l", "r")).alias("key")).where(F.col("key") != "")
        on_l, on_r = F.array_contains("l", F.col("key")), F.array_contains("r", F.col("key"))
        partners = F.array_distinct(F.array(F.when(on_l, F.col("rid")), F.when(on_r, F.col("lid"))))
        partners = F.array_compact(partners)
        out = k.select("pair_id", "positive", "key", F.posexplode_outer(partners).alias("pos", "partner"))
        return out.select(
            F.lit(field).alias("field"), "key", "pair_id", "positive", "partner",
            (F.coalesce("pos", F.lit(0)) == 0).cast("long").alias("first"),
        )

    some = lambda c: F.array_distinct(F.array_compact(F.coalesce(c, F.array().cast("array<string>"))))
    one = lambda c: F.array_compact(F.array(c))
    return keyed("datasets", some(F.col("left.datasets")), some(F.col("right.datasets"))).unionByName(
        keyed("id", one(real_id(F.col("left.id"))), one(real_id(F.col("right.id"))))
    )


def ordered_first(df: DataFrame, key: str, *order: str) -> DataFrame:
    """Window form of first-per-key for keys known to be small; ``first_seen`` is the form for skewed keys."""
    w = W.partitionBy(key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
