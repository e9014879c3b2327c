"""Examples for prompts: random, balanced, diverse or curated selections, what they hold, and their halves for tuning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.operators.ranking import diverse_selection, hash_order

STRATEGIES = ("random", "diverse", "curated")


def select_random(pairs: DataFrame, n: int, key: str = "pair_id", seed: int = 42) -> DataFrame:
    """n rows in hash order, all if there are fewer: a top-k that keeps n rows a task, no sort of all."""
    return pairs.orderBy(hash_order(seed, F.col(key)), key).limit(n)


def select_balanced(pairs: DataFrame, n: int, exclude: DataFrame | None = None, key: str = "pair_id", seed: int = 42) -> DataFrame:
    """n // 2 positive pairs, the rest negative, none of those in ``exclude`` (by ``key``); fewer where a class lacks pairs."""
    left = pairs if exclude is None else pairs.join(exclude.select(key).distinct(), key, "left_anti")
    of = lambda label, k: select_random(left.where(F.col("judgement") == label), k, key, seed)
    return of("positive", n // 2).unionByName(of("negative", n - n // 2))


def select_examples(pairs: DataFrame, strategy: str, n: int, curated: DataFrame | None = None, seed: int = 42) -> DataFrame:
    """Pairs by strategy. Curated examples that aren't there, or are none, give way to a diverse selection."""
    if strategy not in STRATEGIES:
        raise ValueError(f"no such strategy: {strategy}; use one of {', '.join(STRATEGIES)}")
    if strategy == "curated" and curated is not None and not curated.isEmpty():
        return curated.orderBy("pair_id").limit(n)
    if strategy == "random":
        return select_random(pairs, n, seed=seed)
    return diverse_selection(pairs, n, seed).drop("is_person")


def examine(examples: DataFrame, fields: tuple[str, ...] = ("birthDate", "country", "idNumber")) -> DataFrame:
    """One row: total, labels, share of positives, and on how many left sides each field is."""
    has = lambda k: F.coalesce(F.map_contains_key("left.properties", F.lit(k)), F.lit(False))
    n, pos = F.count(F.lit(1)), F.count_if(F.col("judgement") == "positive")
    share = F.coalesce(F.try_divide(pos.cast("double"), n.cast("double")), F.lit(0.0))
    return examples.agg(n.alias("total"), pos.alias("positive"), (n - pos).alias("negative"), share.alias("positive_ratio"), *[F.count_if(has(k)).alias(f"has_{k}") for k in fields])


def schemas_of(examples: DataFrame) -> DataFrame:
    return examples.groupBy(F.coalesce("left.schema", F.lit("Unknown")).alias("schema")).agg(F.count(F.lit(1)).alias("n"))


def prefix_split(df: DataFrame, position: str, n_rows: int, share: float = 0.8) -> DataFrame:
    """Adds ``part``: the first share of positions tunes, the rest validates."""
    return df.withColumn("part", F.when(F.col(position) < int(n_rows * share), "tune").otherwise("validate"))


def first_demos(demos: DataFrame, k: int, by: str = "predictor", position: str = "position") -> DataFrame:
    """The first k demos of each predictor, whose positions count from 0."""
    return demos.where(F.col(position) < k)


def grid_metrics(df: DataFrame, truth: str, candidates: dict[str, Column]) -> DataFrame:
    """Metrics of each candidate, a predicate for ``positive``, all in one pass: rows aren't multiplied by the candidates."""
    from pairloom.operators.metrics import COUNTS, confusion, metrics

    says = {name: F.when(c, "positive").otherwise("negative") for name, c in candidates.items()}
    cells = [F.struct(F.lit(name).alias("candidate"), *confusion(F.col(truth), c)).alias(f"c{i}") for i, (name, c) in enumerate(says.items())]
    one = df.agg(*cells)
    rows = one.select(F.explode(F.array(*[f"c{i}" for i in range(len(cells))])).alias("c")).select("c.candidate", *[f"c.{n}" for n in COUNTS])
    return metrics(rows)


def best_candidate(measured: DataFrame, metric: str = "f1") -> DataFrame:
    """The candidate of the largest metric, the first by name at ties."""
    return measured.orderBy(F.desc(metric), "candidate").limit(1)
