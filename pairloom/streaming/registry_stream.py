"""An extension of the registry: the latest experiment per method, kept up to date from a folder of appended files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pairloom.schema import EXPERIMENT


def experiments_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Experiments as their files arrive, late and repeated ones included."""
    return spark.readStream.schema(EXPERIMENT).json(folder)


def latest_stream(experiments: DataFrame, key: str = "method") -> DataFrame:
    """The latest run of each method. State is one row per method, so no watermark is needed to bound it."""
    row = F.struct("timestamp", "run_id", F.col("metrics.f1").alias("f1"))
    return experiments.groupBy(key).agg(F.max_by(row, F.struct("timestamp", "run_id")).alias("r")).select(key, "r.*")


def start_latest(spark: SparkSession, folder: str, checkpoint: str, name: str = "latest_runs") -> StreamingQuery:
    """Keeps the view in a memory table, a trigger for what is there now."""
    s = latest_stream(experiments_stream(spark, folder)).writeStream.outputMode("complete").format("memory").queryName(name)
    return s.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
