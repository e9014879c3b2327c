"""All queries of the core and their SQL, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pairloom.plans import evaluation, files, profiling, prompting, registries, rendering, sampling, skew

_MODULES = [skew, evaluation, profiling, sampling, registries, rendering, prompting, files]

QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in _MODULES for k, v in m.SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.matcher_report(spark, sf_dir)
