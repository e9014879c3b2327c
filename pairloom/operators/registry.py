"""Experiments and prompts as small registries: latest, best, ranks, upsert, versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest_per(df: DataFrame, key: str, order: str, tie: str) -> DataFrame:
    """The latest row of each key, ties to the largest ``tie``; an aggregate, so no key is gathered in one task."""
    row = F.struct(*df.columns)
    best = df.groupBy(key).agg(F.max_by(row, F.struct(order, tie)).alias("r"))
    return best.select("r.*")


def top_by(df: DataFrame, score: str, k: int, *ties: str) -> DataFrame:
    """The k rows of the largest score, null as 0, in order."""
    return df.orderBy(F.coalesce(F.col(score), F.lit(0.0)).desc(), *ties).limit(k)


def ranked_by(df: DataFrame, score: str, tie: str) -> DataFrame:
    """Adds ``rank`` from 1, for registries that fit one task."""
    w = W.orderBy(F.coalesce(F.col(score), F.lit(0.0)).desc(), tie)
    return df.withColumn("rank", F.row_number().over(w))


def best_prompt(prompts: DataFrame, metric: str = "dev_f1") -> DataFrame:
    """Per model the prompt of the largest metric, null as 0, the first listed at ties."""
    score = F.coalesce(F.col(f"provenance.{metric}"), F.lit(0.0))
    order = F.struct(score, -F.col("position"))
    b = prompts.groupBy("model").agg(F.max_by(F.struct("prompt_id", score.alias("score")), order).alias("b"))
    return b.select("model", "b.prompt_id", "b.score")


def prompt_for(models: DataFrame, prompts: DataFrame, metric: str = "dev_f1") -> DataFrame:
    """``model``, ``prompt_id``, ``score`` for each model asked for: its own best prompt, else the best of ``all``, else none."""
    best = best_prompt(prompts, metric)
    shared = best.where("model = 'all'").select(F.col("prompt_id").alias("all_id"), F.col("score").alias("all_score"))
    asked = models.select("model").distinct().join(best, "model", "left").join(F.broadcast(shared), F.lit(True), "left")
    own = F.col("prompt_id").isNotNull()
    return asked.select("model", F.coalesce("prompt_id", "all_id").alias("prompt_id"), F.when(own, F.col("score")).otherwise(F.col("all_score")).alias("score"))


def prompts_of(prompts: DataFrame, model: str | None = None, optimizer: str | None = None) -> DataFrame:
    """The prompts of a model, of an optimizer, or of both."""
    out = prompts if model is None else prompts.where(F.col("model") == model)
    return out if optimizer is None else out.where(F.col("provenance.optimizer") == optimizer)


def with_files(prompts: DataFrame, files: DataFrame) -> DataFrame:
    """Registry entries with the ``text`` of their file, by ``path``; entries whose file is missing are left out."""
    return prompts.join(files.select("path", "text"), "path")


def load_prompt(prompts: DataFrame, files: DataFrame, id_or_path: str) -> str:
    """The text of a prompt's file, given by its path or by its id; neither is an error."""
    by_path = files.where(F.col("path") == id_or_path).select(F.lit(0).alias("way"), "text")
    by_id = with_files(prompts.where(F.col("prompt_id") == id_or_path), files).select(F.lit(1).alias("way"), "text")
    found = by_path.unionByName(by_id).orderBy("way", "text").first()
    if found is None:
        raise FileNotFoundError(f"no such prompt: {id_or_path}")
    return found.text


def run_id(at: Column) -> Column:
    """A run's name from its time."""
    return F.date_format(at, "yyyyMMdd_HHmmss")


def prompt_id(model: Column, optimizer: Column, day: Column, version: Column) -> Column:
    return F.concat_ws("_", model, optimizer, F.translate(day, "-", ""), F.concat(F.lit("v"), version.cast("string")))


def experiment_rows(evaluated: DataFrame, method: Column, params: Column, notes: Column) -> DataFrame:
    """Rows of the registry of experiments from rows of metrics with a ``run_id``."""
    counts = F.struct("true_negative", "false_positive", "false_negative", "true_positive")
    measured = F.struct("accuracy", "precision", "recall", "f1", counts.alias("confusion_matrix"))
    return evaluated.select("run_id", method.alias("method"), params.alias("params"), measured.alias("metrics"), notes.alias("notes"))


def upsert(base: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """``base`` with the rows of ``fresh`` in place of those of equal key."""
    return base.join(fresh.select(key).distinct(), key, "left_anti").select(*base.columns).unionByName(fresh.select(*base.columns))


def next_versions(prompts: DataFrame) -> DataFrame:
    """Per model and optimizer the number that the next prompt gets."""
    return prompts.groupBy("model", F.col("provenance.optimizer").alias("optimizer")).agg((F.count(F.lit(1)) + 1).alias("next_version"))


def append_experiments(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)
