"""Queries over the file formats: pairs are written below the shared folder in a format and read back with its reader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.operators import metrics as M
from pairloom.operators.entities import positive
from pairloom.operators.ranking import chunked
from pairloom.plans import sql as S
from pairloom.session import Scratch, table
from pairloom.sources import readers as R
from pairloom.sources import writers as K


def _folder(spark: SparkSession, name: str) -> str:
    return f"{Scratch(spark, name).base}/{name}"


def _checked(p: DataFrame) -> DataFrame:
    """Of read pairs what a text comparison needs."""
    return p.select("pair_id", F.col("left.id").alias("left_id"), F.col("right.caption").alias("right_caption"), "judgement", F.coalesce(F.size(F.map_keys("left.properties")), F.lit(0)).alias("n_fields"))


def file_jsonl(spark, d):
    """JSON lines in several files of unequal size, numbered in file order."""
    at = _folder(spark, "jsonl")
    p = table(spark, d, "pairs").select("pair_id", "left", "right", "judgement")
    K.write_jsonl(p.repartitionByRange(5, F.pow(F.col("pair_id"), F.lit(2.0)), "pair_id").sortWithinPartitions("pair_id"), at, F.struct("left", "right", "judgement"))
    return _checked(R.read_pairs(spark, at, "jsonl"))


def file_sample(spark, d):
    """A sample document, written distributedly and read with its positions."""
    at = _folder(spark, "sample")
    p = table(spark, d, "pairs").where("pair_id < 300").select("pair_id", "left", "right", "judgement")
    K.write_sample(p, at, {"seed": 42, "target_ratio": 0.77})
    return _checked(R.read_sample(spark, at))


def file_sample_metadata(spark, d):
    at = _folder(spark, "sample")
    p = table(spark, d, "pairs").where("pair_id < 300").select("pair_id", "left", "right", "judgement")
    K.write_sample(p, at, {"seed": 42, "target_ratio": 0.77})
    return R.sample_metadata(spark, at).select("seed", "n_total", "n_positive", "target_ratio")


def file_published(spark, d):
    """The published layout, one folder a split."""
    at = _folder(spark, "published")
    s = table(spark, d, "pair_splits").where("split is not null").distinct()
    p = table(spark, d, "pairs").select("pair_id", "judgement").join(s, "pair_id")
    p.write.partitionBy("split").parquet(f"{at}/default_")
    # a partitioned folder keeps its column's name in the path, the published layout does not
    for r in s.select("split").distinct().collect():
        p.where(F.col("split") == r.split).drop("split").write.parquet(f"{at}/default/{r.split}")
    return R.read_published(spark, at).groupBy("split").agg(F.count("*").alias("n"), F.count_if(positive(F.col("judgement"))).alias("n_positive"))


def file_training(spark, d):
    """Training files of all formats and splits."""
    at = _folder(spark, "training")
    s = table(spark, d, "pair_splits").where("split is not null").distinct()
    K.write_training(table(spark, d, "pairs").join(s, "pair_id"), at)
    return spark.read.text(at).groupBy("split", "format").agg(F.count("*").alias("n"))


def file_results(spark, d):
    """Prediction rows as JSON lines."""
    at = _folder(spark, "results")
    K.write_results(table(spark, d, "predictions"), at)
    rows = R.read_jsonl(spark, at, table(spark, d, "predictions").schema)
    return M.evaluate(rows, "ground_truth", "classification", "run_id").select("run_id", *M.COUNTS)


def file_chunks(spark, d):
    """Counts of chunks, a document for each, merged."""
    at = _folder(spark, "chunks")
    p = chunked(table(spark, d, "predictions"), "pair_index", 5000, 8)
    K.write_chunks(p.groupBy(F.col("chunk").alias("chunk_id")).agg(*M.confusion(F.col("ground_truth"), F.col("classification"))), at)
    return M.merge_partials(R.read_chunks(spark, at, 8)[0]).select(*M.COUNTS)


QUERIES = {f.__name__: f for f in (file_jsonl, file_sample, file_sample_metadata, file_published, file_training, file_results, file_chunks)}

_CHECKED = "SELECT pair_id, \"left\".id AS left_id, \"right\".caption AS right_caption, judgement, CAST(coalesce(len(map_keys(\"left\".properties)), 0) AS INT) AS n_fields FROM pairs"
_COUNTED = f"SELECT {{by}}tp AS true_positive, fp AS false_positive, fn AS false_negative, tn AS true_negative FROM (SELECT {{by}}{S.cells('ground_truth', 'classification')} FROM predictions {{group}})"
SQL = {
    "file_jsonl": _CHECKED,
    "file_sample": f"{_CHECKED} WHERE pair_id < 300",
    "file_sample_metadata": "SELECT CAST(42 AS BIGINT) AS seed, count(*) AS n_total, count(*) FILTER (judgement = 'positive') AS n_positive, CAST(0.77 AS DOUBLE) AS target_ratio FROM pairs WHERE pair_id < 300",
    "file_published": f"SELECT split, count(*) AS n, count(*) FILTER ({S.positive('judgement')}) AS n_positive FROM pairs JOIN (SELECT DISTINCT pair_id, split FROM pair_splits) USING (pair_id) WHERE split IS NOT NULL GROUP BY 1",
    "file_training": "SELECT split, format, count(*) AS n FROM pairs JOIN (SELECT DISTINCT pair_id, split FROM pair_splits) USING (pair_id), (SELECT unnest(['openai', 'alpaca', 'sharegpt']) AS format) WHERE split IS NOT NULL GROUP BY 1, 2",
    "file_results": _COUNTED.format(by="run_id, ", group="GROUP BY run_id"),
    "file_chunks": _COUNTED.format(by="", group=""),
}
