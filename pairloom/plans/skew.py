"""Queries p4: keys that hold most records, and per-key results that stay balanced."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.operators.entities import key_events
from pairloom.operators.skew import heavy_hitters, skew_aggregate
from pairloom.session import table

#: A key is hot from this share of the rows of pairs.
HOT_SHARE = 0.03


def hot_keys(pairs: DataFrame, share: float = HOT_SHARE) -> DataFrame:
    """``field``, ``key``, ``n_rows`` of every dataset or id found on either side of at least ``share`` of the rows.

    An empty pair table gives no rows. A row counts once for a key, however often it names it.
    """
    least = max(pairs.count() * share, 1e-9)
    once = key_events(pairs.select("pair_id", "left", "right", "judgement")).where("first = 1").select("field", "key")
    return heavy_hitters(once, ["field", "key"], least)


def key_results(pairs: DataFrame, share: float = HOT_SHARE, salts: int = 64) -> DataFrame:
    """``field``, ``key``, ``n_pairs``, ``n_positive``, ``n_partners`` for every dataset and id, without task imbalance."""
    events = key_events(pairs)
    first = F.col("first")
    sums = {"n_pairs": first, "n_positive": first * F.col("positive").cast("long")}
    return skew_aggregate(events, ["field", "key"], hot_keys(pairs, share), sums, "partner", "n_partners", salts)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hot_keys(table(spark, sf_dir, "pairs")).select("field", F.col("key").alias("hot_key"))


def p4_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return key_results(table(spark, sf_dir, "pairs"))


QUERIES = {"p4_found": p4_found, "p4_by_key": p4_by_key}

_EVENTS = """
WITH base AS (
  SELECT pair_id, coalesce(lower(regexp_replace(judgement, '^\\s+|\\s+$', '', 'g')) = 'positive', false) AS positive,
         nullif("left".id, '') AS lid, nullif("right".id, '') AS rid,
         coalesce("left".datasets, []) AS ld, coalesce("right".datasets, []) AS rd FROM pairs),
keys AS (
  SELECT DISTINCT pair_id, 'datasets' AS field, unnest(ld) AS key, rid AS partner FROM base
  UNION SELECT DISTINCT pair_id, 'datasets', unnest(rd), lid FROM base
  UNION SELECT pair_id, 'id', lid, rid FROM base
  UNION SELECT pair_id, 'id', rid, lid FROM base),
kept AS (SELECT k.*, b.positive FROM keys k JOIN base b USING (pair_id) WHERE key IS NOT NULL AND key <> '')
"""

SQL = {
    "p4_found": _EVENTS + """
SELECT field, key AS hot_key FROM kept GROUP BY field, key
HAVING count(DISTINCT pair_id) >= 0.03 * (SELECT count(*) FROM pairs)""",
    "p4_by_key": _EVENTS + """
SELECT field, key, CAST(count(DISTINCT pair_id) AS BIGINT) AS n_pairs,
       CAST(count(DISTINCT pair_id) FILTER (positive) AS BIGINT) AS n_positive,
       CAST(count(DISTINCT partner) AS BIGINT) AS n_partners
FROM kept GROUP BY field, key""",
}
