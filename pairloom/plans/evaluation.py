"""Queries on classifications: confusion, chunks, coverage, thresholds, the matcher end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairloom.functions.similarity import key_similarity, name_keys, score
from pairloom.functions.text import parse_label, prop, token_key
from pairloom.operators import metrics as M
from pairloom.operators.entities import positive
from pairloom.operators.predict import agreement_predictor, predict
from pairloom.operators.ranking import chunked, hash_order, ranked
from pairloom.plans import sql as S
from pairloom.session import spread, table

# The thresholds tried.
THRESHOLDS = [i / 100 for i in range(10, 100, 5)]


def confusion_metrics(spark: SparkSession, d: str) -> DataFrame:
    return M.evaluate(table(spark, d, "predictions"), "ground_truth", "classification", "run_id")


def confusion_skipping_errors(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "predictions").where("classification not in ('error', 'uncertain')")
    return M.evaluate(p, "ground_truth", "classification")


def confusion_by_chunk(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "predictions")
    return chunked(p, "pair_index", 5000, 8).groupBy("chunk").agg(*M.confusion(F.col("ground_truth"), F.col("classification")))


def confusion_merged(spark: SparkSession, d: str) -> DataFrame:
    return M.merge_partials(confusion_by_chunk(spark, d))


def ternary_coverage(spark: SparkSession, d: str) -> DataFrame:
    return M.coverage(table(spark, d, "predictions"), "classification", "run_id")


def token_totals(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "predictions").groupBy("run_id").agg(F.sum(F.coalesce("tokens_used.total", F.lit(0))).alias("total_tokens"))


def weighted_match(spark: SparkSession, d: str) -> DataFrame:
    t, p = F.col("ground_truth"), F.col("classification")
    return table(spark, d, "predictions").groupBy("run_id").agg(
        F.avg(M.weighted_match(t, p)).alias("weighted"), F.avg(M.exact_match(t, p).cast("int")).alias("exact")
    )


def naive_baseline(spark: SparkSession, d: str) -> DataFrame:
    pos = positive(F.col("judgement"))
    return table(spark, d, "pairs").agg(F.count_if(pos).alias("p"), F.count_if(~pos).alias("n")).select(*M.constant_positive(F.col("p"), F.col("n")))


def class_distribution(spark: SparkSession, d: str) -> DataFrame:
    j = F.col("judgement")
    return table(spark, d, "pairs").agg(
        F.count("*").alias("total"), F.count_if(j == "positive").alias("positive"), F.count_if(j == "negative").alias("negative_exact"),
        (F.count("*") - F.count_if(j == "positive")).alias("negative_rest"), F.count_if(F.lower(F.coalesce(j, F.lit(""))) == "negative").alias("negative_any_case"),
    )


def key_scored(spark: SparkSession, d: str) -> DataFrame:
    """Scores with equality of sorted words as the name's part, so that SQL can follow."""
    keys = lambda e: F.transform(prop(e, "name"), token_key)
    same = F.arrays_overlap(keys("left"), keys("right")).cast("double")
    return table(spark, d, "pairs").select("pair_id", "judgement", score(same).alias("score"))


def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    return M.threshold_counts(key_scored(spark, d), "score", "judgement", THRESHOLDS)


def best_threshold(spark: SparkSession, d: str) -> DataFrame:
    return M.best_threshold(threshold_sweep(spark, d))


def fuzzy_scores(spark: SparkSession, d: str) -> DataFrame:
    p = spread(table(spark, d, "pairs").select("pair_id", "judgement", "left", "right"))
    p = p.withColumns({"lk": name_keys(prop("left", "name")), "rk": name_keys(prop("right", "name"))})
    return p.select("pair_id", "judgement", score(key_similarity(F.col("lk"), F.col("rk"))).alias("score"))


def matcher_report(spark: SparkSession, d: str) -> DataFrame:
    """Entry point 1: score every pair once, tune the threshold on the dev half, report both halves."""
    ids = table(spark, d, "pairs").select("pair_id")
    order = ranked(ids.withColumn("h", hash_order(42, F.col("pair_id"))), "h", "pair_id")
    halves = order.select("pair_id", F.when(F.col("rank") < ids.count() // 2, "dev").otherwise("test").alias("part"))
    scored = fuzzy_scores(spark, d).join(halves, "pair_id")
    swept = M.threshold_counts(scored, "score", "judgement", THRESHOLDS, "part")
    # a few dozen rows by now; the dev half's best threshold is spread over them without scoring again
    dev = F.when((F.col("part") == "dev") & (F.col("f1") > 0), F.struct("f1", (-F.col("threshold")).alias("below")))
    best = F.coalesce(-F.max(dev).over(W.partitionBy())["below"], F.lit(0.5))
    return swept.withColumn("best", best).where("threshold = best").drop("best")


def stub_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """A deterministic predictor through the plug-in interface, evaluated like any other."""
    pairs = table(spark, d, "pairs").select("pair_id", "judgement", "left", "right")
    return M.evaluate(predict(pairs, agreement_predictor).join(pairs.select("pair_id", "judgement"), "pair_id"), "judgement", "classification")


def parsed_labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "predictions").select(parse_label(F.col("ground_truth")).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    confusion_metrics, confusion_skipping_errors, confusion_by_chunk, confusion_merged, ternary_coverage, token_totals, weighted_match, naive_baseline,
    class_distribution, key_scored, threshold_sweep, best_threshold, fuzzy_scores, matcher_report, stub_evaluation, parsed_labels,
)}

_CELLS = S.cells("ground_truth", "classification")
_CHUNK = "least(floor(pair_index / 625), 7)"


def _overlap(l: str, r: str) -> str:
    return f"len(list_intersect([{S.norm('x')} for x in {l}], [{S.norm('x')} for x in {r}])) > 0"


def _years(e: str) -> str:
    clean = f"[regexp_replace(x, '^{S.WS}+|{S.WS}+$', '', 'g') for x in {S.prop(e, 'birthDate')}]"
    return f"[y[1:4] for y in {clean} if regexp_matches(y, '^[0-9]{{4}}')]"


_SCORED = f"""
SELECT pair_id, judgement, least(1.0::DOUBLE, (CASE WHEN
    len(list_intersect([{S.token_key('x')} for x in {S.prop('left', 'name')}], [{S.token_key('x')} for x in {S.prop('right', 'name')}])) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 0.7::DOUBLE
  + CASE WHEN {_overlap(S.prop('left', 'country') + ' || ' + S.prop('left', 'nationality'), S.prop('right', 'country') + ' || ' + S.prop('right', 'nationality'))}
      THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END
  + CASE WHEN {_overlap(S.prop('left', 'birthDate'), S.prop('right', 'birthDate'))} THEN 0.2::DOUBLE
      WHEN {_overlap(_years('left'), _years('right'))} THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END) AS score FROM pairs"""
_SWEEP = S.with_f1(f"""SELECT threshold, {S.cells('judgement', "CASE WHEN score >= threshold THEN 'positive' END")}
  FROM ({_SCORED}) CROSS JOIN (SELECT unnest({THRESHOLDS})::DOUBLE AS threshold) GROUP BY threshold""", "threshold")  # fmt: skip

_WORDS = lambda e: f"[w for w in regexp_split_to_array(lower(coalesce(\"{e}\".caption, '')), '{S.WS}+') if w <> '']"
_STUB = f"SELECT judgement, CASE WHEN list_has_any({_WORDS('left')}, {_WORDS('right')}) THEN 'positive' ELSE 'negative' END AS said FROM pairs"
SQL = {
    "stub_evaluation": S.with_f1(f"SELECT {S.cells('judgement', 'said')} FROM ({_STUB})", ""),
    "confusion_metrics": S.with_f1(f"SELECT run_id, {_CELLS} FROM predictions GROUP BY run_id", "run_id"),
    "confusion_skipping_errors": S.with_f1(f"SELECT {_CELLS} FROM predictions WHERE classification NOT IN ('error', 'uncertain')", ""),
    "confusion_by_chunk": f"""SELECT CAST({_CHUNK} AS BIGINT) AS chunk, tp AS true_positive, fp AS false_positive, fn AS false_negative, tn AS true_negative
      FROM (SELECT {_CHUNK} AS c, * FROM (SELECT any_value(pair_index) AS pair_index, {_CELLS} FROM predictions GROUP BY {_CHUNK}))""",
    "confusion_merged": S.with_f1(f"SELECT {_CELLS} FROM predictions", ""),
    "ternary_coverage": """SELECT run_id, count(*) AS n, CAST(count(*) FILTER (classification = 'error') AS BIGINT) AS n_errors,
      CAST(count(*) FILTER (classification = 'uncertain') AS BIGINT) AS n_uncertain,
      coalesce((count(*) - count(*) FILTER (classification IN ('error', 'uncertain')))::DOUBLE / nullif(count(*) - count(*) FILTER (classification = 'error'), 0), 0.0) AS coverage
      FROM predictions GROUP BY run_id""",
    "token_totals": "SELECT run_id, CAST(sum(coalesce(tokens_used.total, 0)) AS BIGINT) AS total_tokens FROM predictions GROUP BY run_id",
    "weighted_match": """SELECT run_id, avg(CASE WHEN coalesce(lower(trim(ground_truth)) = lower(trim(classification)), false)
        THEN CASE WHEN lower(trim(ground_truth)) = 'negative' THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END ELSE 0.0::DOUBLE END) AS weighted,
      avg(coalesce(lower(trim(ground_truth)) = lower(trim(classification)), false)::INT) AS exact FROM predictions GROUP BY run_id""",
    "naive_baseline": f"""SELECT CASE WHEN p > 0 THEN 2.0::DOUBLE * r / (r + 1) ELSE 0 END AS f1, r AS precision, CASE WHEN p > 0 THEN 1.0::DOUBLE ELSE 0 END AS recall, r AS accuracy
      FROM (SELECT p, p::DOUBLE / n AS r FROM (SELECT count(*) FILTER ({S.positive('judgement')}) AS p, count(*) AS n FROM pairs))""",
    "class_distribution": """SELECT count(*) AS total, CAST(count(*) FILTER (judgement = 'positive') AS BIGINT) AS positive,
      CAST(count(*) FILTER (judgement = 'negative') AS BIGINT) AS negative_exact, CAST(count(*) - count(*) FILTER (judgement = 'positive') AS BIGINT) AS negative_rest,
      CAST(count(*) FILTER (lower(judgement) = 'negative') AS BIGINT) AS negative_any_case FROM pairs""",
    "key_scored": _SCORED,
    "threshold_sweep": _SWEEP,
    "best_threshold": f"SELECT CASE WHEN f1 > 0 THEN threshold ELSE 0.5 END AS threshold, f1 FROM ({_SWEEP}) ORDER BY f1 DESC, threshold LIMIT 1",
    "parsed_labels": """SELECT CASE WHEN contains(lower(ground_truth), 'positive') THEN 'positive' ELSE 'negative' END AS label, count(*) AS n FROM predictions GROUP BY 1""",
}
