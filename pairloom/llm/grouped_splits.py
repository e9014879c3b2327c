"""Queries p1: splits that keep related records together, by grouped iterative stratification.

Components of pairs that share ids are found by randomised contraction and their labels counted. Components are then
placed label by label, the rarest outstanding label first, into the split that needs it most, and moved once more where
that brings the splits nearer to the plan. Components with the same label counts are alike to that rule, so it is run over
classes of them: a class of m alike components is poured over the splits as the rule would place them one after another,
which is water-filling. Only the class table, whose size is
bounded and checked, reaches the driver; which component of a class goes where is decided by its rank in hash order,
counted over buckets, so no class meets in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pairloom.llm.components import connected_components
from pairloom.llm.match_groups import components_sql
from pairloom.operators.entities import pair_ids, positive
from pairloom.operators.skew import heavy_hitters, skew_join
from pairloom.session import Scratch, table

LABELS = ["positive", "negative", "other"]
#: A component with this share of all pairs or more is a class of its own, so there are at most a thousand of them.
SINGLE_SHARE = 0.001
#: Most classes that may reach the driver. Label counts are rounded to fewer bits until the classes are no more; at the
#: last step only powers of two are left, 41 values a label for counts below 2^40, so three labels stay below the bound.
MAX_CLASSES, BITS = 100_000, (8, 5, 3, 1, 0)
#: Ranks within a class are counted over buckets of about this many components.
BUCKET_ROWS = 200_000
#: Ids in this share of the pairs are joined apart.
HOT_SHARE = 0.01


def pair_groups(pairs: DataFrame) -> DataFrame:
    """``pair_id``, ``label``, ``group_id``: the smallest id among all pairs that can't be parted from this one.

    Any pair links its two ids, whatever its judgement. A pair with one id goes with that id; a pair with none has a null
    ``group_id``. A pair linked to no other pair is a group alone.
    """
    p = pair_ids(pairs.select("pair_id", "left", "right", "judgement"))
    comps = connected_components(p, "lid", "rid")
    j = F.lower(F.regexp_replace("judgement", r"(?U)^\s+|\s+$", ""))
    label = F.when(positive(F.col("judgement")), "positive").when(j == "negative", "negative").otherwise("other")
    ids = pairs.select(
        "pair_id", label.alias("label"),
        F.coalesce(F.nullif("left.id", F.lit("")), F.nullif("right.id", F.lit(""))).alias("id"),
    )
    total = pairs.count()
    scratch = Scratch(pairs.sparkSession, "groups")
    heavy = scratch.save(heavy_hitters(ids, ["id"], max(1.0, total * HOT_SHARE)), "heavy")
    with_group = skew_join(ids, comps, "id", heavy)
    return with_group.select("pair_id", "label", F.coalesce("group_id", "id").alias("group_id"))


def place(classes: list[tuple], ratios: dict[str, float]) -> dict[tuple, dict[str, int]]:
    """How many components of each class go to each split. classes: (key, number, counts by label) in any order.

    Iterative stratification: the label with the fewest pairs outstanding is taken next; its classes, those with most
    pairs of it first, are poured so that the split that needs the label most gets the next component.
    """
    names = sorted(ratios)
    share = [ratios[s] / sum(ratios.values()) for s in names]
    n_labels = len(classes[0][2]) if classes else 0
    totals = [sum(n * v[i] for _, n, v in classes) for i in range(n_labels)]
    need = [[t * s for t in totals] for s in share]
    room = [sum(totals) * s for s in share]
    left, todo, out = totals[:], sorted(classes, key=lambda c: (str(c[0]))), {}
    while todo:
        open_labels = [i for i in range(n_labels) if left[i] > 1e-9]
        if not open_labels:
            break
        rare = min(open_labels, key=lambda i: left[i])
        mine = sorted((c for c in todo if c[2][rare] > 0), key=lambda c: (-c[2][rare], -sum(c[2]), str(c[0])))
        for key, n, v in mine:
            got = _pour(n, v[rare], [d[rare] for d in need], room, sum(v))
            out[key] = {s: g for s, g in zip(names, got) if g}
            for k, g in enumerate(got):
                room[k] -= g * sum(v)
                for i in range(n_labels):
                    need[k][i] -= g * v[i]
            for i in range(n_labels):
                left[i] -= n * v[i]
        done = {c[0] for c in mine}
        todo = [c for c in todo if c[0] not in done]
        left[rare] = 0
    return _polish(classes, names, share, out)


def _polish(classes: list[tuple], names: list[str], share: list[float], out: dict, passes: int = 8) -> dict[tuple, dict[str, int]]:
    """Moves components of a class between splits while that brings labels and sizes nearer to what is wanted.

    A huge component may take more of a label than its split should have; the greedy rule then fills the other splits
    with that label and overfills them with what comes along. How many of a class to move from one split to another has
    a closed optimum, as the squared relative miss is quadratic in it.
    """
    import numpy as np

    if not classes:
        return out
    vec = {k: np.array([*v, sum(v)], float) for k, _, v in classes}
    totals = sum(n * vec[k] for k, n, _ in classes)
    scale = np.where(totals > 0, 1 / np.sqrt(np.maximum(totals, 1)), 0.0)
    miss = {s: -r * totals * scale for s, r in zip(names, share)}
    for k, per_split in out.items():
        for s, n in per_split.items():
            miss[s] = miss[s] + n * vec[k] * scale
    order = sorted(out, key=lambda k: (-vec[k][-1], str(k)))
    for _ in range(passes):
        moved = 0
        for k in order:
            w = vec[k] * scale
            ww = float(w @ w)
            for a in names:
                for b in names:
                    have = out[k].get(a, 0)
                    if a == b or not have or not ww:
                        continue
                    n = min(have, round(float((miss[a] - miss[b]) @ w) / (2 * ww)))
                    if n > 0:
                        out[k][a], out[k][b] = have - n, out[k].get(b, 0) + n
                        miss[a], miss[b], moved = miss[a] - n * w, miss[b] + n * w, moved + n
        if not moved:
            break
    return {k: {s: n for s, n in v.items() if n} for k, v in out.items()}


def _pour(n: int, weight: float, need: list[float], room: list[float], size: float) -> list[int]:
    """Splits n alike components as if each went to the split with the largest need, ties to the one with most room."""
    if n <= 32:
        need, room, got = need[:], room[:], [0] * len(need)
        for _ in range(n):
            k = max(range(len(need)), key=lambda i: (round(need[i], 9), room[i], -i))
            got[k] += 1
            need[k] -= weight
            room[k] -= size
        return got
    # the level to which the needs fall: the splits above it give what is over it
    low, high = min(need) - n * weight, max(need)
    for _ in range(200):
        mid = (low + high) / 2
        if sum(max(0.0, d - mid) for d in need) > n * weight:
            low = mid
        else:
            high = mid
    exact = [max(0.0, d - high) / weight for d in need]
    got = [math.floor(x) for x in exact]
    for k in sorted(range(len(need)), key=lambda i: (got[i] - exact[i], -room[i], i))[: n - sum(got)]:
        got[k] += 1
    got[max(range(len(got)), key=lambda i: exact[i])] += n - sum(got)
    return got


def assign_splits(groups: DataFrame, plan: DataFrame, scratch: Scratch, max_classes: int = MAX_CLASSES) -> DataFrame:
    """``group_key``, ``split`` for ``groups`` of ``group_key`` and the counts named in ``LABELS``.

    Every group gets a split; where classes would be too many even when rounded, it is an error.
    """
    ratios = {r.split: float(r.ratio) for r in plan.where("split is not null and ratio > 0").select("split", "ratio").collect()}
    if not ratios:
        raise ValueError("the split plan names no split with a positive ratio")
    size = sum((F.col(c) for c in LABELS[1:]), F.col(LABELS[0]))
    total, n_groups = groups.agg(F.sum(size), F.count(F.lit(1))).first()
    single = size >= F.lit(max(2.0, (total or 0) * SINGLE_SHARE))

    def rounded(c: str, bits: int):
        x = F.col(c)
        unit = F.pow(F.lit(2.0), F.greatest(F.lit(0), F.floor(F.log2(F.greatest(x, F.lit(1)).cast("double"))) - bits))
        return (F.floor(x / unit) * unit).cast("long")

    for bits in BITS:
        keyed = groups.withColumn(
            "cls",
            F.when(single, F.concat(F.lit("="), "group_key")).otherwise(
                F.concat_ws(",", *[rounded(c, bits).cast("string") for c in LABELS])
            ),
        )
        per_class = keyed.groupBy("cls").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in LABELS])
        rows = per_class.limit(max_classes + 1).collect()
        if len(rows) <= max_classes:
            break
    else:
        raise RuntimeError(f"more than {max_classes} classes of components")
    quotas = place([(r.cls, r.n, tuple(r[c] / r.n for c in LABELS)) for r in rows], ratios)
    spans = []
    for cls, per_split in quotas.items():
        start = 0
        for split in sorted(per_split):
            spans.append((cls, start, start + per_split[split], split))
            start += per_split[split]
    spark = groups.sparkSession
    spans_df = F.broadcast(spark.createDataFrame(spans, "cls string, first long, beyond long, split string"))
    buckets = max(1, math.ceil((n_groups or 0) / BUCKET_ROWS))
    placed = keyed.select("group_key", "cls", F.xxhash64("group_key").alias("h")).withColumn(
        "bucket", F.pmod("h", F.lit(buckets))
    )
    offsets = placed.groupBy("cls", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("cls").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = offsets.select("cls", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    rank = F.row_number().over(W.partitionBy("cls", "bucket").orderBy("h", "group_key")) - 1
    ranked = placed.withColumn("rank", rank).join(offsets, ["cls", "bucket"]).withColumn("rank", F.col("rank") + F.col("before"))
    inside = (ranked.cls == spans_df.cls) & (ranked["rank"] >= spans_df["first"]) & (ranked["rank"] < spans_df.beyond)
    return ranked.join(spans_df, inside).select("group_key", "split")


def grouped_splits(pairs: DataFrame, plan: DataFrame) -> DataFrame:
    """``pair_id``, ``group_id``, ``split`` for every pair; pairs of one group share the split.

    Ratios and the mix of judgements are met as nearly as whole groups allow. Pairs without any id have a null
    ``group_id`` and are placed one by one. An empty pair table gives no rows, a plan without ratios is an error.
    Judgements other than positive and negative, nulls included, are a label of their own.
    """
    scratch = Scratch(pairs.sparkSession, "splits")
    grouped = pair_groups(pairs)
    key = F.coalesce(F.concat(F.lit("g"), "group_id"), F.concat(F.lit("p"), F.col("pair_id").cast("string")))
    grouped = scratch.save(grouped.withColumn("group_key", key), "grouped")
    counts = [F.sum((F.col("label") == c).cast("long")).alias(c) for c in LABELS]
    groups = scratch.save(grouped.groupBy("group_key").agg(*counts), "groups")
    chosen = assign_splits(groups, plan, scratch)
    # the groups are counted already
    large = groups.select("group_key", sum((F.col(c) for c in LABELS[1:]), F.col(LABELS[0])).alias("n_rows"))
    heavy = scratch.save(large.where(F.col("n_rows") >= max(1.0, pairs.count() * HOT_SHARE)).select("group_key"), "heavy")
    return skew_join(grouped, chosen, "group_key", heavy).select("pair_id", "group_id", "split")


def p1_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped_splits(table(spark, sf_dir, "pairs"), table(spark, sf_dir, "split_plan"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups that the split keeps together."""
    return p1_splits(spark, sf_dir).where("group_id is not null and split is not null").select("pair_id", "group_id")


def p1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per split: the wanted share of pairs and the share it got, of all pairs and of the positive ones."""
    pairs = table(spark, sf_dir, "pairs")
    got = p1_splits(spark, sf_dir).join(pairs.select("pair_id", positive(F.col("judgement")).alias("pos")), "pair_id")
    got = got.groupBy("split").agg(F.count("*").alias("n"), F.sum(F.col("pos").cast("long")).alias("n_pos"))
    everything = W.partitionBy()
    shares = got.select(
        "split", "n", "n_pos", (F.col("n") / F.sum("n").over(everything)).alias("share"),
        (F.col("n_pos") / F.sum("n_pos").over(everything)).alias("positive_share"),
    )
    return table(spark, sf_dir, "split_plan").join(shares, "split", "left")


QUERIES = {"p1_found": p1_found, "p1_splits": p1_splits, "p1_mix": p1_mix}
SQL = {
    "p1_found": components_sql("true") + """ SELECT pair_id, coalesce(cc.group_id, p.id) AS group_id
      FROM (SELECT pair_id, coalesce(nullif("left".id, ''), nullif("right".id, '')) AS id FROM pairs) p LEFT JOIN cc ON cc.id = p.id WHERE p.id IS NOT NULL""",
}
