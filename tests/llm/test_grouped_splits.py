import random

import pytest
from pyspark.sql import functions as F

from pairdata import ent, pairs
from pairloom.llm.grouped_splits import assign_splits, grouped_splits, place
from pairloom.session import Scratch
from test_components import brute

PLAN = [("train", 0.7), ("val", 0.1), ("test", 0.2)]


def plan(spark):
    return spark.createDataFrame(PLAN, "split string, ratio double")


def test_place_meets_ratios():
    classes = [("a", 1000, (1.0, 0.0)), ("b", 500, (0.0, 1.0)), ("c", 3, (40.0, 2.0)), ("d", 90, (1.0, 2.0))]
    got = place(classes, dict(PLAN))
    assert {k: sum(v.values()) for k, v in got.items()} == {k: n for k, n, _ in classes}
    for label in (0, 1):
        total = sum(n * v[label] for _, n, v in classes)
        for split, ratio in PLAN:
            mine = sum(got[k].get(split, 0) * v[label] for k, _, v in classes)
            assert abs(mine - ratio * total) <= 45
    assert place([], dict(PLAN)) == {}


def test_groups_stay_together(spark):
    rng = random.Random(5)
    rows, edges = [], []
    for _ in range(400):
        a, b = f"n{rng.randrange(500):03d}", f"n{rng.randrange(500):03d}"
        if rng.random() < 0.7:
            a, b = f"x{rng.randrange(9000):04d}", f"y{rng.randrange(9000):04d}"
        rows.append((ent(a), ent(b), rng.choice(["positive", "negative ", None])))
        edges.append((a, b))
    rows += [(ent(None), ent(""), "positive"), (ent(None), ent("alone"), "odd"), (ent("self"), ent("self"), "positive"), (None, None, None)]
    df = pairs(spark, rows).withColumn("label", F.lit(0)).withColumn("group_id", F.lit(0))
    got = grouped_splits(df, plan(spark)).collect()
    assert sorted(r.pair_id for r in got) == list(range(len(rows)))
    want = brute(edges)
    by_pair = {r.pair_id: r for r in got}
    for i, (a, _) in enumerate(edges):
        assert by_pair[i].group_id == want.get(a, a)
    assert [by_pair[400 + i].group_id for i in range(4)] == [None, "alone", "self", None]
    splits = {}
    for r in got:
        if r.group_id is not None:
            splits.setdefault(r.group_id, set()).add(r.split)
    assert all(len(s) == 1 and None not in s for s in splits.values()) and all(r.split for r in got)
    n = {s: sum(r.split == s for r in got) for s, _ in PLAN}
    biggest = max(sum(r.group_id == g for r in got) for g in splits)
    assert all(abs(n[s] - ratio * len(rows)) <= max(12, biggest) for s, ratio in PLAN)


def test_empty(spark):
    assert grouped_splits(pairs(spark, []), plan(spark)).count() == 0


def test_too_many_classes_lose_no_group(spark):
    rng = random.Random(2)
    rows = [(f"g{i}", rng.randrange(1, 4000), rng.randrange(4000), rng.randrange(3)) for i in range(3000)]
    groups = spark.createDataFrame(rows, "group_key string, positive long, negative long, other long")
    scratch = Scratch(spark, "t")
    for most in (100_000, 600):
        got = assign_splits(groups, plan(spark), scratch, most).collect()
        assert sorted(r.group_key for r in got) == sorted(r[0] for r in rows) and all(r.split for r in got)
    with pytest.raises(RuntimeError):
        assign_splits(groups, plan(spark), scratch, 20)
