import random

from pyspark.sql import functions as F

from pairdata import ent, pairs
from pairloom.llm.overlaps import cross_split_overlaps, record_shingles


def rec(rng, i):
    return dict(
        id=f"i{i}", caption=f"name {rng.randrange(40)} of the house", datasets=[f"d{rng.randrange(3)}"], first_seen="2020-01-01",
        name=[f"name {rng.randrange(40)}", "other words in a longer line of text"], notes=[f"file {i} of list"], idNumber=[str(i)],
    )


def changed(rng, r):
    r = dict(r) | {"id": f"{r['id']}x"}
    if rng.random() < 0.5:
        r["topic"] = ["sanction"]
    if rng.random() < 0.5:
        r["notes"] = [r["notes"][0].upper() + "  "]
    if rng.random() < 0.4:
        r["idNumber"] = ["1"]
    return r


def test_equals_brute_force(spark):
    rng = random.Random(3)
    rows, splits = [], []
    for i in range(60):
        a, b = rec(rng, 2 * i), rec(rng, 2 * i + 1)
        rows.append((ent(**a), ent(**b), "positive"))
        for _ in range(rng.randrange(3)):
            x, y = changed(rng, a), changed(rng, b)
            rows.append((ent(**y), ent(**x), None) if rng.random() < 0.5 else (ent(**x), ent(**y), "negative"))
        rows.append((ent(**a), ent(**rec(rng, 5000 + i)), "positive"))
    rows += [(None, None, None), (None, None, None), (ent("x", schema=None), None, None), rows[0], (None, rows[0][0], None), (rows[0][0], None, None)]
    splits = [(i, rng.choice(["train", "val", "test"])) for i in range(len(rows) - 2)] + [(0, "train"), (0, "test"), (3, None)]
    splits += [(len(rows) - 2, "train"), (len(rows) - 1, "val")]
    df = pairs(spark, rows).withColumn("split", F.lit("train")).withColumn("token", F.lit(1))
    sp = spark.createDataFrame(splits, "pair_id long, split string")
    got = {(r.eval_id, r.eval_split, r.train_id) for r in cross_split_overlaps(df, sp).collect()}
    sets = {r.pair_id: (set(r.a), set(r.b)) for r in df.select("pair_id", record_shingles("left").alias("a"), record_shingles("right").alias("b")).collect()}
    jac = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
    want = set()
    for e, s in set(splits):
        for t, s2 in set(splits):
            if s in ("val", "test") and s2 == "train" and e != t:
                (a, b), (c, d) = sets[e], sets[t]
                if (a | b) and (c | d) and jac(a | b, c | d) >= 0.8 and max(min(jac(a, c), jac(b, d)), min(jac(a, d), jac(b, c))) >= 0.6:
                    want.add((e, s, t))
    assert got == want and len(want) > 20


def test_empty(spark):
    sp = spark.createDataFrame([], "pair_id long, split string")
    assert cross_split_overlaps(pairs(spark, []), sp).count() == 0
    assert cross_split_overlaps(pairs(spark, [(ent("a", "x"), None, None)]), sp).count() == 0
