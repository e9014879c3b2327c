"""Queries that sample, split, slice and validate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.operators import ranking as R
from pairloom.operators import validate as V
from pairloom.plans import sql as S
from pairloom.session import table

RATIOS = (0.7, 0.05)


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pairs")


def shuffled_rank(spark, d):
    p = _pairs(spark, d).select("pair_id").withColumn("h", R.hash_order(42, F.col("pair_id")))
    return R.ranked(p, "h", "pair_id").select("pair_id", "rank")


def stratified_sample_exact(spark, d):
    p = _pairs(spark, d).select("pair_id", "judgement")
    return R.stratified_sample(p, "judgement", {"positive": 77, "negative": 23}, "pair_id")


def stratified_sample_short(spark, d):
    p = _pairs(spark, d).where("judgement like 'P%'").select("pair_id", "judgement")
    return R.stratified_sample(p, "judgement", {"Positive": 1_000_000, "POSITIVE": 3}, "pair_id", strict=False)


def diverse_selection(spark, d):
    return R.diverse_selection(_pairs(spark, d), 40).select("pair_id", "judgement", "is_person")


def entity_split_reference(spark, d):
    return R.entity_split(_pairs(spark, d), RATIOS)


def entity_split_strict(spark, d):
    return R.entity_split(_pairs(spark, d), RATIOS, strict=True)


def split_overlap(spark, d):
    return R.split_overlap(_pairs(spark, d), table(spark, d, "pair_splits").distinct())


def split_shares(spark, d):
    """The wanted shares against the delivered ones."""
    s = table(spark, d, "pair_splits").distinct().groupBy("split").agg(F.count("*").alias("n"))
    total = s.agg(F.sum("n").alias("total"))
    return table(spark, d, "split_plan").join(s, "split", "left").crossJoin(F.broadcast(total)).select("split", "ratio", (F.col("n") / F.col("total")).alias("got"))


def anti_by_value(spark, d):
    """Documents whose text and language occur in none of source match_log."""
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", "source")
    return R.minus_by_value(docs, docs.where("source = 'match_log'"), ["text", "lang"]).select("doc_id")


def exclude_range(spark, d):
    return _pairs(spark, d).where(~F.col("pair_id").between(200, 999)).agg(F.count("*").alias("n"), F.min("pair_id").alias("lo"), F.max("pair_id").alias("hi"))


def dev_test_slice(spark, d):
    part = F.when(F.col("pair_id") < 200, "dev").otherwise("test").alias("part")
    return _pairs(spark, d).groupBy(part).agg(F.count("*").alias("n"), F.count_if(F.col("judgement") == "positive").alias("n_positive"))


def offset_limit(spark, d):
    return _pairs(spark, d).where(F.col("pair_id").between(100, 149)).select("pair_id", "judgement")


def last_n(spark, d):
    return table(spark, d, "predictions").select("created_at", "run_id", "pair_index").distinct().orderBy(F.desc("created_at"), F.desc("run_id"), F.desc("pair_index")).limit(20)


def chunk_ranges(spark, d):
    p = _pairs(spark, d)
    return R.chunked(p, "pair_id", p.count(), 7).groupBy("chunk").agg(F.min("pair_id").alias("first"), F.max("pair_id").alias("last"), F.count("*").alias("n"))


def pool_carving(spark, d):
    """The first fifth of positions is the pool; a sample of it trains, what else the pool has validates."""
    p = _pairs(spark, d)
    pool = p.where(F.col("pair_id") < F.lit(p.count() // 5)).select("pair_id", "judgement", "left", "right")
    train = R.stratified_sample(pool, "judgement", {"positive": 38, "negative": 12}, "pair_id", strict=False)
    rest = R.minus_by_value(pool, train, ["left", "right", "judgement"])
    return train.select("pair_id", F.lit("train").alias("part")).unionByName(rest.select("pair_id", F.lit("pool").alias("part")))


def run_count(spark, d):
    return V.run_count(_pairs(spark, d), "pair_id", "judgement", block=1000)


def window_both_classes(spark, d):
    return V.windows_with_both(_pairs(spark, d), "pair_id", "judgement")


def sample_validation(spark, d):
    return V.validate_sample(_pairs(spark, d), "pair_id", "judgement", 0.57)


def content_checksum(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


def json_validate(spark, d):
    e = table(spark, d, "events").select(F.when(F.col("value") < 5, F.concat(F.lit("{"), "props")).otherwise(F.col("props")).alias("props"))
    return V.check_json(e, "props", ["k"])


_FUNCTIONS = [
    shuffled_rank, stratified_sample_exact, stratified_sample_short, diverse_selection, entity_split_reference, entity_split_strict, split_overlap, split_shares,
    anti_by_value, exclude_range, dev_test_slice, offset_limit, last_n, chunk_ranges, pool_carving, run_count, window_both_classes, sample_validation,
    content_checksum, json_validate,
]
QUERIES = {f.__name__: f for f in _FUNCTIONS}

_H = "md5('42|' || pair_id)"
_STRATA = "SELECT pair_id, judgement, row_number() OVER (PARTITION BY judgement ORDER BY {h}, pair_id) AS r FROM {t}"
_IDS = """ids AS (SELECT DISTINCT id FROM (SELECT "left".id AS id FROM pairs UNION ALL SELECT "right".id FROM pairs) WHERE id <> ''),
  ord AS (SELECT id, row_number() OVER (ORDER BY md5('42|' || id), id) - 1 AS r, count(*) OVER () AS n FROM ids),
  sp AS (SELECT id, CASE WHEN r < floor(n * 0.7::DOUBLE) THEN 'train' WHEN r < floor(n * (0.7::DOUBLE + 0.05::DOUBLE)) THEN 'val' ELSE 'test' END AS s FROM ord),
  j AS (SELECT pair_id, a.s AS ls, b.s AS rs FROM pairs p LEFT JOIN sp a ON a.id = p."left".id LEFT JOIN sp b ON b.id = p."right".id)"""
_DIVERSE = f"""SELECT pair_id, judgement, is_person FROM (
  SELECT *, row_number() OVER (PARTITION BY judgement ORDER BY (r > quota)::INT, h, pair_id) AS k FROM (
    SELECT *, CASE WHEN judgement = 'positive' THEN 25 ELSE 15 END AS total,
      CASE WHEN judgement = 'positive' THEN CASE WHEN is_person THEN 15 ELSE 10 END ELSE CASE WHEN is_person THEN 9 ELSE 6 END END AS quota FROM (
      SELECT pair_id, judgement, is_person, {_H} AS h, row_number() OVER (PARTITION BY judgement, is_person ORDER BY {_H}, pair_id) AS r
      FROM (SELECT *, coalesce("left".schema = 'Person', false) AS is_person FROM pairs) WHERE judgement IN ('positive', 'negative'))) WHERE r <= total) WHERE k <= total"""
_RUNS = """SELECT CAST(CASE WHEN count(*) = 0 THEN 0 ELSE 1 + count(*) FILTER (prev_id IS NOT NULL AND judgement IS DISTINCT FROM prev) END AS BIGINT) AS n_runs
  FROM (SELECT judgement, lag(judgement) OVER (ORDER BY pair_id) AS prev, lag(pair_id) OVER (ORDER BY pair_id) AS prev_id FROM pairs)"""
_CARVE = f"""WITH pool AS (SELECT * FROM pairs WHERE pair_id < (SELECT count(*) // 5 FROM pairs)),
  tr AS (SELECT pair_id FROM ({_STRATA.format(h=_H, t='pool')}) WHERE (judgement = 'positive' AND r <= 38) OR (judgement = 'negative' AND r <= 12)),
  vals AS (SELECT DISTINCT "left"::VARCHAR AS l, "right"::VARCHAR AS r, judgement AS j FROM pool WHERE pair_id IN (SELECT pair_id FROM tr))
SELECT pair_id, 'train' AS part FROM tr UNION ALL
SELECT pair_id, 'pool' FROM pool WHERE NOT EXISTS (SELECT 1 FROM vals WHERE l IS NOT DISTINCT FROM "left"::VARCHAR AND r IS NOT DISTINCT FROM "right"::VARCHAR AND j IS NOT DISTINCT FROM judgement)"""
SQL = {
    "shuffled_rank": f"SELECT pair_id, row_number() OVER (ORDER BY {_H}, pair_id) - 1 AS rank FROM pairs",
    "stratified_sample_exact": f"SELECT pair_id, judgement FROM ({_STRATA.format(h=_H, t='pairs')}) WHERE (judgement = 'positive' AND r <= 77) OR (judgement = 'negative' AND r <= 23)",
    "stratified_sample_short": f"SELECT pair_id, judgement FROM ({_STRATA.format(h=_H, t='pairs')}) WHERE judgement = 'Positive' OR (judgement = 'POSITIVE' AND r <= 3)",
    "diverse_selection": _DIVERSE,
    "entity_split_reference": f"WITH {_IDS} SELECT pair_id, CASE WHEN ls = 'train' OR rs = 'train' THEN 'train' WHEN ls = rs THEN ls ELSE 'train' END AS split FROM j",
    "entity_split_strict": f"WITH {_IDS} SELECT pair_id, ls AS split FROM j WHERE ls = rs",
    "split_overlap": """WITH u AS (SELECT DISTINCT id, split FROM (SELECT pair_id, unnest(["left".id, "right".id]) AS id FROM pairs) JOIN pair_splits USING (pair_id) WHERE id <> '')
      SELECT a.split AS split_a, b.split AS split_b, count(*) AS n_ids FROM u a JOIN u b ON a.id = b.id AND a.split < b.split GROUP BY 1, 2""",
    "split_shares": """WITH s AS (SELECT split, count(*) AS n FROM (SELECT DISTINCT * FROM pair_splits) GROUP BY 1)
      SELECT split, ratio, n::DOUBLE / (SELECT sum(n) FROM s) AS got FROM split_plan LEFT JOIN s USING (split)""",
    "anti_by_value": """SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents x WHERE x.source = 'match_log' AND x.text IS NOT DISTINCT FROM d.text AND x.lang IS NOT DISTINCT FROM d.lang)""",
    "exclude_range": "SELECT count(*) AS n, min(pair_id) AS lo, max(pair_id) AS hi FROM pairs WHERE NOT pair_id BETWEEN 200 AND 999",
    "dev_test_slice": "SELECT CASE WHEN pair_id < 200 THEN 'dev' ELSE 'test' END AS part, count(*) AS n, CAST(count(*) FILTER (judgement = 'positive') AS BIGINT) AS n_positive FROM pairs GROUP BY 1",
    "offset_limit": "SELECT pair_id, judgement FROM pairs WHERE pair_id BETWEEN 100 AND 149",
    "last_n": "SELECT DISTINCT created_at, run_id, pair_index FROM predictions ORDER BY created_at DESC, run_id DESC, pair_index DESC LIMIT 20",
    "chunk_ranges": """SELECT CAST(least(pair_id // (SELECT count(*) // 7 FROM pairs), 6) AS BIGINT) AS chunk, min(pair_id) AS first, max(pair_id) AS last, count(*) AS n FROM pairs GROUP BY 1""",
    "pool_carving": _CARVE,
    "run_count": _RUNS,
    "window_both_classes": """SELECT count(*) AS n_windows, CAST(count(*) FILTER (p > 0 AND q > 0) AS BIGINT) AS n_both FROM (SELECT pair_id // 100 AS w, count(*) AS n,
      count(*) FILTER (judgement = 'positive') AS p, count(*) FILTER (judgement = 'negative') AS q FROM pairs GROUP BY 1) WHERE n = 100""",
    "sample_validation": f"""SELECT n, p::DOUBLE / n AS ratio, abs(p::DOUBLE / n - 0.57::DOUBLE) <= 0.02::DOUBLE AS ratio_ok, n_runs, 2.0::DOUBLE * p * q / n + 1 AS expected_runs,
      n_runs > (2.0::DOUBLE * p * q / n + 1) * 0.7::DOUBLE AS shuffled FROM (SELECT count(*) AS n, count(*) FILTER (judgement = 'positive') AS p, count(*) FILTER (judgement = 'negative') AS q FROM pairs), ({_RUNS})""",
    "content_checksum": "SELECT doc_id, sha256(text) AS digest FROM documents",
    "json_validate": """SELECT count(p) AS n, CAST(count(*) FILTER (NOT json_valid(p)) AS BIGINT) AS n_broken, CAST(count(*) FILTER (json_valid(p) AND json_extract(CASE WHEN json_valid(p) THEN p END, '$.k') IS NULL) AS BIGINT) AS lacks_k,
      count(*) FILTER (NOT json_valid(p)) = 0 AS valid FROM (SELECT CASE WHEN value < 5 THEN '{' || props ELSE props END AS p FROM events)""",
}
