"""Exact ranks without a window over all rows, and the samples, splits and slices built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def hash_order(seed: int, key: Column) -> Column:
    """A shuffle's order: md5 of seed and key, the same on every run and in every engine."""
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def ranked(df: DataFrame, order: str, tie: str, *strata: str, rank: str = "rank", digits: int = 3) -> DataFrame:
    """Adds the 0-based rank by a hex-string column within strata.

    Rows are counted by the order's first ``digits`` hex digits; the counts' running sum says where a prefix starts, and
    only within a prefix are rows sorted, so a stratum of any size is spread over ``16 ** digits`` groups.
    """
    p = df.withColumn("_prefix", F.substring(order, 1, digits))
    n = p.groupBy(*strata, "_prefix").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*strata).orderBy("_prefix").rowsBetween(W.unboundedPreceding, -1)
    starts = n.select(*strata, "_prefix", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    keys = [*strata, "_prefix"]
    cond = [p[k].eqNullSafe(starts[k]) for k in keys]
    joined = p.join(F.broadcast(starts), cond).select(p["*"], starts["_before"])
    own = F.row_number().over(W.partitionBy(*keys).orderBy(order, tie)) - 1
    return joined.withColumn(rank, F.col("_before") + own).drop("_prefix", "_before")


def stratified_sample(df: DataFrame, stratum: str, sizes: dict[str, int], key: str, seed: int = 42, strict: bool = True) -> DataFrame:
    """Exactly so many rows of each stratum, in hash order. Too few rows are an error if strict, else all are taken."""
    own = df.where(F.col(stratum).isin(list(sizes))).withColumn("_h", hash_order(seed, F.col(key)))
    if strict:
        have = {r[0]: r[1] for r in own.groupBy(stratum).count().collect()}
        short = {k: v for k, v in sizes.items() if have.get(k, 0) < v}
        if short:
            raise ValueError(f"not enough rows: wanted {short}, have {have}")
    quota = F.create_map(*[F.lit(x) for item in sizes.items() for x in item])
    r = ranked(own, "_h", key, stratum)
    return r.where(F.col("rank") < F.try_element_at(quota, F.col(stratum))).drop("rank", "_h")


def diverse_selection(pairs: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n pairs: 62.5 % positive, of each class 60 % persons, each share at least one; what a stratum lacks is filled from
    the rest of its class. Adds ``is_person``. Fewer come out where a class lacks pairs."""
    pos = max(1, int(n * 0.625))
    want = {"positive": pos, "negative": n - pos}
    person = F.coalesce(F.col("left.schema") == "Person", F.lit(False))
    own = pairs.where(F.col("judgement").isin(list(want))).withColumns({"is_person": person, "_h": hash_order(seed, F.col("pair_id"))})
    quota = {(j, p): (max(1, int(k * 0.6)) if p else k - max(1, int(k * 0.6))) for j, k in want.items() for p in (True, False)}
    spark = pairs.sparkSession
    q = F.broadcast(spark.createDataFrame([(j, p, v, want[j]) for (j, p), v in quota.items()], "judgement string, is_person boolean, quota long, total long"))
    r = ranked(own, "_h", "pair_id", "judgement", "is_person").join(q, ["judgement", "is_person"])
    # within a class, those inside their quota come first, the others fill up in hash order
    r = r.where(F.col("rank") < F.col("total")).withColumn("_spare", (F.col("rank") >= F.col("quota")).cast("int"))
    w = W.partitionBy("judgement").orderBy("_spare", "_h", "pair_id")
    return r.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= F.col("total")).drop("rank", "quota", "total", "_spare", "_n", "_h")


def entity_split(pairs: DataFrame, ratios: tuple[float, float], seed: int = 42, strict: bool = False) -> DataFrame:
    """``pair_id``, ``split`` by entity: ids in hash order, the first share train, the next val, the rest test.

    A pair whose ids fall into different splits goes to train, or is left out if strict. A missing id is in no split,
    so its pair goes to train, too, or is left out.
    """
    ids = pairs.select(F.explode(F.array("left.id", "right.id")).alias("id")).where("id <> ''").distinct()
    r = ranked(ids.withColumn("_h", hash_order(seed, F.col("id"))), "_h", "id")
    n = ids.count()
    a, b = int(n * ratios[0]), int(n * (ratios[0] + ratios[1]))
    of = r.select("id", F.when(F.col("rank") < a, "train").when(F.col("rank") < b, "val").otherwise("test").alias("s"))
    p = pairs.select("pair_id", F.col("left.id").alias("lid"), F.col("right.id").alias("rid"))
    p = p.join(of.select(F.col("id").alias("lid"), F.col("s").alias("ls")), "lid", "left")
    p = p.join(of.select(F.col("id").alias("rid"), F.col("s").alias("rs")), "rid", "left")
    both = F.when(F.col("ls") == F.col("rs"), F.col("ls"))
    if strict:
        return p.select("pair_id", both.alias("split")).where("split is not null")
    split = F.when((F.col("ls") == "train") | (F.col("rs") == "train"), "train").otherwise(F.coalesce(both, F.lit("train")))
    return p.select("pair_id", split.alias("split"))


def split_overlap(pairs: DataFrame, splits: DataFrame) -> DataFrame:
    """``split_a``, ``split_b``, ``n_ids``: ids in pairs of both splits."""
    ids = pairs.select("pair_id", F.explode(F.array("left.id", "right.id")).alias("id")).where("id <> ''")
    per = ids.join(splits.select("pair_id", "split"), "pair_id").select("id", "split").distinct()
    held = per.groupBy("id").agg(F.array_sort(F.collect_set("split")).alias("s")).where(F.size("s") > 1)
    both = held.select(F.explode(F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))).alias("p"))
    return both.groupBy(F.col("p.a").alias("split_a"), F.col("p.b").alias("split_b")).agg(F.count(F.lit(1)).alias("n_ids"))


def chunked(df: DataFrame, position: str, n_rows: int, chunks: int) -> DataFrame:
    """Adds ``chunk``: equal ranges of positions, the remainder goes to the last one."""
    size = max(1, n_rows // chunks)
    return df.withColumn("chunk", F.least(F.floor(F.col(position) / size), F.lit(chunks - 1)))


def minus_by_value(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of ``a`` whose values in the columns don't occur in ``b``; nulls are values. Compared by a 256-bit digest."""
    digest = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    return a.withColumn("_d", digest).join(b.select(digest.alias("_d")).distinct(), "_d", "left_anti").drop("_d")
