"""Evaluation of classifiers: confusion counts, metrics, thresholds, partial results and their merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COUNTS = ["true_positive", "false_positive", "false_negative", "true_negative"]


def confusion(truth: Column, predicted: Column) -> list[Column]:
    """The four counts in one pass; whatever isn't ``positive`` is negative, null included."""
    return [F.count_if(c).alias(n) for n, c in zip(COUNTS, _cells(truth, predicted), strict=True)]


def _cells(truth: Column, predicted: Column) -> list[Column]:
    t, p = (F.coalesce(c == "positive", F.lit(False)) for c in (truth, predicted))
    return [t & p, ~t & p, t & ~p, ~t & ~p]


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def f_measure(p: Column, r: Column) -> Column:
    return F.coalesce(F.try_divide(F.lit(2.0) * (p * r), p + r), F.lit(0.0))


def metrics(df: DataFrame) -> DataFrame:
    """Accuracy, precision, recall and F1 of both classes from the four counts; a zero denominator gives 0."""
    tp, fp, fn, tn = (F.col(c) for c in COUNTS)
    out = df.withColumns({"accuracy": ratio(tp + tn, tp + fp + fn + tn), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn)})
    out = out.withColumns({"negative_precision": ratio(tn, tn + fn), "negative_recall": ratio(tn, tn + fp)})
    return out.withColumns({
        "f1": f_measure(F.col("precision"), F.col("recall")),
        "negative_f1": f_measure(F.col("negative_precision"), F.col("negative_recall")),
    })


def evaluate(df: DataFrame, truth: str, predicted: str, *by: str) -> DataFrame:
    """Confusion counts and metrics, for each group of ``by``. No rows give one row of zeros, or none with groups."""
    return metrics(df.groupBy(*by).agg(*confusion(F.col(truth), F.col(predicted))))


def evaluate_batch(df: DataFrame, truth: str, predicted: str, error: str, *by: str) -> DataFrame:
    """Metrics of the rows that have a truth and an answer, how many these are (``n_evaluated``) and how many failed."""
    failed = F.col(error).isNotNull() | F.coalesce(F.col(predicted) == "error", F.lit(False))
    used = F.col(truth).isNotNull() & F.col(predicted).isNotNull() & ~failed
    cells = [F.count_if(used & c).alias(n) for n, c in zip(COUNTS, _cells(F.col(truth), F.col(predicted)), strict=True)]
    extra = [F.count_if(used).alias("n_evaluated"), F.count_if(failed).alias("n_errors")]
    return metrics(df.groupBy(*by).agg(*cells, *extra))


def merge_partials(parts: DataFrame, *by: str) -> DataFrame:
    """Metrics from the counts of several chunks: the chunks' sums, as for all rows at once."""
    return metrics(parts.groupBy(*by).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS]))


def threshold_counts(df: DataFrame, score: str, truth: str, thresholds: list[float], *by: str) -> DataFrame:
    """Counts and metrics for each threshold; a score at the threshold is positive.

    Each row is put at the last threshold it reaches in one aggregation; the few sums, one per threshold, are then added
    up for each threshold, so rows aren't multiplied by the thresholds and are scored once.
    """
    ts = sorted(thresholds)
    reached = lambda s: F.size(F.filter(F.array(*[F.lit(float(t)) for t in ts]), lambda t: F.coalesce(s >= t, F.lit(False))))
    # the score is bound to a variable, or the planner would put its expression into the filter and work it out each time
    level = F.element_at(F.transform(F.array(score), reached), 1)
    pos = F.coalesce(F.col(truth) == "positive", F.lit(False))
    per = df.groupBy(*by, level.alias("level")).agg(F.count_if(pos).alias("p"), F.count_if(~pos).alias("n"))
    levels = per.groupBy(*by).agg(F.collect_list(F.struct("level", "p", "n")).alias("ls"))
    grid = F.array(*[F.struct(F.lit(i + 1).alias("i"), F.lit(float(t)).alias("threshold")) for i, t in enumerate(ts)])
    at = levels.select(*by, "ls", F.explode(grid).alias("t"))

    def total(name: str, reached: bool):
        rows = F.filter("ls", lambda x: (x["level"] >= F.col("t.i")) == F.lit(reached))
        return F.aggregate(rows, F.lit(0).cast("long"), lambda acc, x: acc + x[name])

    cells = [("p", True), ("n", True), ("p", False), ("n", False)]
    return metrics(at.select(*by, "t.threshold", *[total(*c).alias(n) for n, c in zip(COUNTS, cells, strict=True)]))


def best_threshold(swept: DataFrame, *by: str) -> DataFrame:
    """The threshold of the largest F1, the smallest at ties, and 0.5 where no F1 is above 0."""
    best = F.max_by(F.struct("threshold", "f1"), F.struct("f1", -F.col("threshold")))
    b = swept.groupBy(*by).agg(best.alias("b"))
    return b.select(*by, F.when(F.col("b.f1") > 0, F.col("b.threshold")).otherwise(0.5).alias("threshold"), F.col("b.f1").alias("f1"))


def constant_positive(positive: Column, negative: Column) -> list[Column]:
    """Metrics of calling everything positive; all 0 without positives. Unrounded."""
    p = ratio(positive, positive + negative)
    some = positive > 0
    zero = F.lit(0.0)
    return [
        F.when(some, F.lit(2.0) * p / (p + 1.0)).otherwise(zero).alias("f1"), F.when(some, p).otherwise(zero).alias("precision"),
        F.when(some, F.lit(1.0)).otherwise(zero).alias("recall"), F.when(some, p).otherwise(zero).alias("accuracy"),
    ]


def exact_match(truth: Column, predicted: Column) -> Column:
    """Equal without case and surrounding blanks; two nulls don't match."""
    return F.coalesce(F.lower(F.trim(truth)) == F.lower(F.trim(predicted)), F.lit(False))


def weighted_match(truth: Column, predicted: Column) -> Column:
    """1.5 for a right negative, 1 for a right positive, 0 else."""
    t = F.lower(F.trim(truth))
    return F.when(exact_match(truth, predicted), F.when(t == "negative", 1.5).otherwise(1.0)).otherwise(0.0)


def coverage(df: DataFrame, predicted: str, *by: str) -> DataFrame:
    """Rows, errors and abstentions, and the share of error-free rows that got a class."""
    p = F.col(predicted)
    n, err, unc = F.count(F.lit(1)), F.count_if(p == "error"), F.count_if(p == "uncertain")
    return df.groupBy(*by).agg(n.alias("n"), err.alias("n_errors"), unc.alias("n_uncertain"), ratio(n - err - unc, n - err).alias("coverage"))
