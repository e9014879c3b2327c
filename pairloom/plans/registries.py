"""Queries on the registries of experiments and prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.functions.text import SHOWN_MODELS, display_name, is_local_model, safe_name
from pairloom.operators import registry as G
from pairloom.session import table


def _runs(spark: SparkSession, d: str) -> DataFrame:
    """Distinct experiments; the map column is kept as sorted entries, as maps can't be compared."""
    e = table(spark, d, "experiments")
    ps = F.array_sort(F.map_entries("params"))
    return e.select("run_id", "timestamp", "method", "input_file", "notes", F.to_json(ps).alias("params"), "metrics").distinct()


def _prompts(spark: SparkSession, d: str) -> DataFrame:
    """Distinct prompts with their position: order of listing is that of date and id."""
    p = table(spark, d, "prompt_registry").distinct()
    from pyspark.sql import Window as W

    return p.withColumn("position", F.row_number().over(W.orderBy("created_date", "prompt_id")))


def latest_per_method(spark, d):
    r = _runs(spark, d).select("method", "timestamp", "run_id", F.col("metrics.f1").alias("f1"))
    return G.latest_per(r, "method", "timestamp", "run_id")


def rank_by_f1(spark, d):
    r = _runs(spark, d).select("run_id", F.col("metrics.f1").alias("f1"))
    return G.ranked_by(r, "f1", "run_id")


def top_runs(spark, d):
    return G.top_by(_runs(spark, d).select("run_id", "method", F.col("metrics.f1").alias("f1")), "f1", 10, "run_id")


def exact_method(spark, d):
    return _runs(spark, d).where(F.col("method") == "rule-base").select("run_id")


def method_family(spark, d):
    return _runs(spark, d).where(F.lower("method").contains("matcher")).select("run_id", "method")


def experiment_compare(spark, d):
    m = lambda c: F.format_string("%.2f", F.col(f"metrics.{c}") * 100).alias(c)
    return _runs(spark, d).where("method is not null").select("run_id", "method", m("accuracy"), m("precision"), m("recall"), m("f1"))


def group_report(spark, d):
    model = F.substring_index("method", " ", 1)
    return _runs(spark, d).groupBy(display_name(model).alias("model")).agg(F.count("*").alias("n"), F.max("metrics.f1").alias("best_f1"), F.avg("metrics.f1").alias("mean_f1"))


def model_names(spark, d):
    model = F.substring_index("method", " ", 1)
    return _runs(spark, d).select("run_id", safe_name(model).alias("folder"), is_local_model(model).alias("is_local"))


def metrics_recomputed(spark, d):
    """Runs whose stored F1 differs from that of their stored counts."""
    c = lambda n: F.col(f"metrics.confusion_matrix.{n}")
    f1 = F.try_divide(2.0 * c("true_positive"), 2.0 * c("true_positive") + c("false_positive") + c("false_negative"))
    return _runs(spark, d).select("run_id", (F.abs(F.coalesce(f1, F.lit(0.0)) - F.coalesce("metrics.f1", F.lit(0.0))) < 1e-9).alias("ok"))


def best_prompt(spark, d):
    return G.best_prompt(_prompts(spark, d))


def next_version(spark, d):
    return G.next_versions(_prompts(spark, d))


def registry_upsert(spark, d):
    """Scored prompts replaced by versions with another score, and a successor added for each."""
    base = _prompts(spark, d).select("prompt_id", "model", F.col("provenance.dev_f1").alias("dev_f1"), F.lit("old").alias("state"))
    changed = base.where("dev_f1 > 0.7").withColumns({"dev_f1": F.col("dev_f1") / 2, "state": F.lit("new")})
    fresh = changed.unionByName(changed.withColumns({"prompt_id": F.concat("prompt_id", F.lit("_next")), "state": F.lit("added")}))
    return G.upsert(base, fresh, "prompt_id")


def unlisted_runs(spark, d):
    """Runs with predictions that no experiment of the matchers lists."""
    return table(spark, d, "predictions").select("run_id").distinct().join(method_family(spark, d).select("run_id"), "run_id", "left_anti")


def runs_without_errors(spark, d):
    """Runs without a prediction that failed."""
    failed = table(spark, d, "predictions").where("classification = 'error'").select("run_id")
    return _runs(spark, d).select("run_id").distinct().join(failed, "run_id", "left_anti")


_FUNCTIONS = [
    latest_per_method, rank_by_f1, top_runs, exact_method, method_family, experiment_compare, group_report, model_names, metrics_recomputed, best_prompt,
    next_version, registry_upsert, unlisted_runs, runs_without_errors,
]
QUERIES = {f.__name__: f for f in _FUNCTIONS}

_R = "WITH r AS (SELECT DISTINCT run_id, \"timestamp\" AS ts, method, input_file, notes, params::VARCHAR AS params, metrics FROM experiments)"
_P = "WITH p AS (SELECT *, row_number() OVER (ORDER BY created_date, prompt_id) AS position FROM (SELECT DISTINCT * FROM prompt_registry))"
_MODEL = "split_part(method, ' ', 1)"
_CASES = " ".join(
    f"WHEN contains(lower({_MODEL}), '{k}') THEN {f"'{v}'" if v else f"replace({_MODEL}, 'gpt-', 'GPT-')"}" for k, v in SHOWN_MODELS.items()
)
_SHOWN = f"CASE {_CASES} ELSE coalesce({_MODEL}, 'Unknown') END"
_PERCENT = ", ".join(f"printf('%.2f', metrics.{c} * 100) AS {c}" for c in ("accuracy", "precision", "recall", "f1"))
SQL = {
    "latest_per_method": f"{_R} SELECT method, ts AS timestamp, run_id, metrics.f1 AS f1 FROM r QUALIFY row_number() OVER (PARTITION BY method ORDER BY ts DESC, run_id DESC) = 1",
    "rank_by_f1": f"{_R} SELECT run_id, metrics.f1 AS f1, CAST(row_number() OVER (ORDER BY coalesce(metrics.f1, 0) DESC, run_id) AS INT) AS rank FROM r",
    "top_runs": f"{_R} SELECT run_id, method, metrics.f1 AS f1 FROM r ORDER BY coalesce(metrics.f1, 0) DESC, run_id LIMIT 10",
    "exact_method": f"{_R} SELECT run_id FROM r WHERE method = 'rule-base'",
    "method_family": f"{_R} SELECT run_id, method FROM r WHERE contains(lower(method), 'matcher')",
    "experiment_compare": f"{_R} SELECT run_id, method, {_PERCENT} FROM r WHERE method IS NOT NULL",
    "group_report": f"{_R} SELECT {_SHOWN} AS model, count(*) AS n, max(metrics.f1) AS best_f1, avg(metrics.f1) AS mean_f1 FROM r GROUP BY 1",
    "model_names": f"{_R} SELECT run_id, translate({_MODEL}, '.-', '__') AS folder, coalesce(regexp_matches(lower({_MODEL}), 'llama|deepseek|qwen|mixtral'), false) AS is_local FROM r",
    "metrics_recomputed": f"""{_R} SELECT run_id, abs(coalesce(2.0::DOUBLE * m.true_positive / nullif(2 * m.true_positive + m.false_positive + m.false_negative, 0), 0) - coalesce(f1, 0)) < 1e-9 AS ok
      FROM (SELECT run_id, metrics.confusion_matrix AS m, metrics.f1 AS f1 FROM r)""",
    "best_prompt": f"{_P} SELECT model, prompt_id, coalesce(provenance.dev_f1, 0) AS score FROM p QUALIFY row_number() OVER (PARTITION BY model ORDER BY coalesce(provenance.dev_f1, 0) DESC, position) = 1",
    "next_version": f"{_P} SELECT model, provenance.optimizer AS optimizer, count(*) + 1 AS next_version FROM p GROUP BY 1, 2",
    "registry_upsert": f"""{_P}, b AS (SELECT prompt_id, model, provenance.dev_f1 AS f, coalesce(provenance.dev_f1 > 0.7, false) AS hit FROM p)
      SELECT prompt_id, model, CASE WHEN hit THEN f / 2 ELSE f END AS dev_f1, CASE WHEN hit THEN 'new' ELSE 'old' END AS state FROM b
      UNION ALL SELECT prompt_id || '_next', model, f / 2, 'added' FROM b WHERE hit""",
    "unlisted_runs": "SELECT DISTINCT run_id FROM predictions WHERE run_id NOT IN (SELECT run_id FROM experiments WHERE contains(lower(method), 'matcher'))",
    "runs_without_errors": "SELECT DISTINCT run_id FROM experiments WHERE run_id NOT IN (SELECT run_id FROM predictions WHERE classification = 'error' AND run_id IS NOT NULL)",
}
