"""Queries p3: one group identifier for all records that positive pairs link, directly or indirectly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pairloom.llm.components import connected_components
from pairloom.operators.entities import pair_ids
from pairloom.session import table


def match_groups(pairs: DataFrame) -> DataFrame:
    """``id``, ``group_id``: ids linked by positive pairs, with the smallest id of the group.

    A pair links if both ids are there and its judgement reads ``positive`` without blanks and case; pairs that say
    otherwise undo nothing, pairs of an id with itself link nothing.
    """
    linked = pair_ids(pairs).where("positive and lid is not null and rid is not null")
    return connected_components(linked, "lid", "rid")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_groups(table(spark, sf_dir, "pairs"))


def p3_group_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many groups there are of each size."""
    from pyspark.sql import functions as F

    sizes = p3_found(spark, sf_dir).groupBy("group_id").agg(F.count("*").alias("n_ids"))
    return sizes.groupBy("n_ids").agg(F.count("*").alias("n_groups"))


QUERIES = {"p3_found": p3_found, "p3_group_sizes": p3_group_sizes}

def components_sql(linked: str) -> str:
    """Recursive SQL: ``cc`` of ``id`` and ``group_id`` for the pairs that the condition links. The smallest id spreads along the edges."""
    return f"""WITH RECURSIVE e AS (SELECT "left".id AS a, "right".id AS b FROM pairs WHERE "left".id <> '' AND "right".id <> '' AND "left".id <> "right".id AND {linked}),
  edges AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
  cc(id, group_id) USING KEY (id) AS (
    SELECT a, least(a, min(b)) FROM edges GROUP BY a
    UNION SELECT n.id, n.g FROM (SELECT d.b AS id, min(cc.group_id) AS g FROM cc JOIN edges d ON cc.id = d.a GROUP BY d.b) n JOIN recurring.cc r ON r.id = n.id WHERE n.g < r.group_id)"""


_POSITIVE = "coalesce(lower(trim(judgement)) = 'positive', false)"
SQL = {
    "p3_found": components_sql(_POSITIVE) + " SELECT id, group_id FROM cc",
    "p3_group_sizes": components_sql(_POSITIVE) + " SELECT n_ids, count(*) AS n_groups FROM (SELECT count(*) AS n_ids FROM cc GROUP BY group_id) GROUP BY n_ids",
}
