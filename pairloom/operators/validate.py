"""Checks of samples and files: runs, windows with both classes, digests, JSON records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def run_count(df: DataFrame, position: str, value: str, block: int = 100_000) -> DataFrame:
    """``n_runs`` of equal values in order of position, 0 for no rows.

    Changes are counted within blocks of positions, in parallel; only the blocks' first and last values are then compared
    across blocks, so no window holds all rows. Null is a value.
    """
    b = df.select((F.floor(F.col(position) / block)).alias("b"), F.col(position).alias("i"), F.col(value).alias("v"))
    w = W.partitionBy("b").orderBy("i")
    b = b.withColumn("first", F.row_number().over(w) == 1)
    b = b.withColumn("change", ~F.col("v").eqNullSafe(F.lag("v").over(w)) & ~F.col("first"))
    per = b.groupBy("b").agg(F.count_if("change").alias("n"), F.min_by(F.struct("v"), "i").alias("lo"), F.max_by(F.struct("v"), "i").alias("hi"))
    order = W.orderBy("b")
    per = per.withColumns({"before": F.lag("hi").over(order)})
    seam = F.col("before").isNotNull() & ~F.col("lo.v").eqNullSafe(F.col("before.v"))
    return per.agg(F.when(F.count(F.lit(1)) == 0, F.lit(0)).otherwise(F.sum("n") + F.count_if(seam) + 1).cast("long").alias("n_runs"))


def windows_with_both(df: DataFrame, position: str, label: str, size: int = 100) -> DataFrame:
    """``n_windows`` full windows of positions, and ``n_both`` of them with positive and negative rows."""
    w = df.groupBy(F.floor(F.col(position) / size).alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == "positive").alias("p"), F.count_if(F.col(label) == "negative").alias("q")
    ).where(F.col("n") == size)
    return w.agg(F.count(F.lit(1)).alias("n_windows"), F.count_if((F.col("p") > 0) & (F.col("q") > 0)).alias("n_both"))


def validate_sample(df: DataFrame, position: str, label: str, target: float, tolerance: float = 0.02, least_runs: float = 0.7) -> DataFrame:
    """One row: class ratio near the target, and runs as a shuffled order has them."""
    c = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == "positive").alias("p"), F.count_if(F.col(label) == "negative").alias("q"))
    x = c.crossJoin(run_count(df, position, label))
    expected = F.coalesce(F.try_divide(2.0 * F.col("p") * F.col("q"), F.col("n")), F.lit(0.0)) + 1.0
    ratio = F.coalesce(F.try_divide(F.col("p").cast("double"), F.col("n")), F.lit(0.0))
    return x.select(
        "n", ratio.alias("ratio"), (F.abs(ratio - target) <= tolerance).alias("ratio_ok"), "n_runs", expected.alias("expected_runs"),
        (F.col("n_runs") > expected * least_runs).alias("shuffled"),
    )


def file_digests(spark, path: str) -> DataFrame:
    """``path``, ``sha256`` of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def check_digests(found: DataFrame, expected: DataFrame) -> DataFrame:
    """``path``, ``ok``: false where a digest differs or is missing on either side."""
    f, e = found.select("path", F.col("sha256").alias("f")), expected.select("path", F.col("sha256").alias("e"))
    return f.join(e, "path", "full").select("path", F.coalesce(F.col("f") == F.col("e"), F.lit(False)).alias("ok"))


def check_json(df: DataFrame, column: str, required: list[str], keys_matter: bool = False) -> DataFrame:
    """One row: records, broken ones, those that lack each required key, and whether the file is valid.

    Missing keys make it invalid only if ``keys_matter``; broken records always do.
    """
    ok = F.try_parse_json(column)
    broken = ok.isNull() & F.col(column).isNotNull()
    lacks = [F.count_if(ok.isNotNull() & F.get_json_object(column, f"$.{k}").isNull()).alias(f"lacks_{k}") for k in required]
    out = df.agg(F.count(column).alias("n"), F.count_if(broken).alias("n_broken"), *lacks)
    valid = F.col("n_broken") == 0
    for k in required if keys_matter else []:
        valid = valid & (F.col(f"lacks_{k}") == 0)
    return out.withColumn("valid", valid)
