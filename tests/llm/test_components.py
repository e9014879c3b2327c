import random

import pytest
from pyspark.sql import functions as F

from pairdata import ent, pairs
from pairloom.llm.components import connected_components
from pairloom.llm.match_groups import match_groups


def brute(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            up[find(a)] = find(b)
    groups = {}
    for x in list(up):
        groups.setdefault(find(x), []).append(x)
    return {x: min(g) for g in groups.values() for x in g}


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    edges = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(35)]
    edges += [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(90)] + [("hub", f"s{i}") for i in range(80)]
    edges += [("n1", None), (None, None), ("n2", "n2"), ("", "é"), ("hub", "s1"), ("s1", "hub")]
    df = spark.createDataFrame(edges, "a string, b string").withColumn("u", F.lit(1)).withColumn("key", F.lit("x"))
    got = {r.id: r.group_id for r in connected_components(df).collect()}
    assert got == brute(edges)


def test_hash_clashes_are_told_apart(spark):
    edges = [(f"a{i}", f"b{i % 7}") for i in range(30)]
    df = spark.createDataFrame(edges, "a string, b string")
    weak = lambda c: F.pmod(F.xxhash64(c), F.lit(16))
    assert {r.id: r.group_id for r in connected_components(df, hashed=weak).collect()} == brute(edges)


def test_empty_and_pairs(spark):
    assert connected_components(spark.createDataFrame([], "a string, b string")).count() == 0
    rows = [
        (ent("b"), ent("a"), " POSITIVE\t"), (ent("b"), ent("c"), "negative"), (ent("c"), ent(""), "positive"),
        (ent("d"), ent("b"), "positive"), (ent("b"), ent("a"), "negative"), (None, ent("a"), "positive"), (ent("e"), ent("f"), None),
    ]
    got = {r.id: r.group_id for r in match_groups(pairs(spark, rows)).collect()}
    assert got == {"a": "a", "b": "a", "d": "a"}
