import random

import numpy as np
from pyspark.sql import functions as F

from pairloom.llm.leaks import RADIUS, build_index, candidates, leaks, lookup

RNG = random.Random(7)
WORDS = ["".join(RNG.choice("abcdefghijklmnoprstuv") for _ in range(RNG.randrange(2, 9))) for _ in range(3000)]


def words(n):
    return [RNG.choice(WORDS) for _ in range(n)]


def test_lookup_equals_brute_force():
    index = build_index([(i, " ".join(words(40))) for i in range(30)])
    rng = np.random.default_rng(0)
    fp = index["fp"][rng.integers(0, len(index["fp"]), 400)]
    for _ in range(4):
        fp = fp ^ (np.uint64(1) << rng.integers(0, 64, len(fp)).astype(np.uint64))
    got = set(zip(*map(np.ndarray.tolist, lookup(index, fp)), strict=True))
    near = np.bitwise_count(fp[:, None] ^ index["fp"][None, :]) <= RADIUS
    assert got == set(zip(*map(np.ndarray.tolist, np.nonzero(near)), strict=True)) and got


def test_planted_passages(spark):
    items = [(i, " ".join(words(50))) for i in range(20)]
    docs, want = [], set()
    for d in range(120):
        w, i = words(RNG.randrange(0, 150)), RNG.randrange(20)
        part, kind = items[i][1].split(), d % 4
        lo = RNG.randrange(0, 25)
        if kind == 0:
            w[len(w) // 2 : len(w) // 2] = [x.upper() + RNG.choice([",", "", "."]) for x in part[lo : lo + 20]]
        elif kind == 1:
            p = part[lo : lo + 24]
            p[10] = "changed"
            w += p
        elif kind == 2:
            w += part[lo : lo + 9]
        if kind < 2:
            want.add((d, i))
        docs.append((d, "  ".join(w)))
    docs += [(900, None), (901, ""), (902, " . "), (903, " ".join(words(90_000) + items[3][1].split())), (904, "東京都は日本の首都である。" * 3)]
    want.add((903, 3))
    items += [(50, None), (51, ""), (52, "short one"), (53, "姓名得分很高，因此审核员决定把这两份记录合并为同一个人，并且在当天晚上通知了所有相关部门的负责人员")]
    docs += [(905, "他说" + items[-1][1][2:46] + "了"), (906, items[-1][1][:20])]
    want.add((905, 53))
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("x"))
    i = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("x"))
    assert {(r.doc_id, r.item_id) for r in leaks(d.union(d), i).collect()} == want
    assert leaks(d.limit(0), i).count() == 0 and leaks(d, i.limit(0)).count() == 0


def test_blocks_of_items_change_nothing(spark):
    stock = " ".join(words(9))
    items = [(i, f"{' '.join(words(8))} {stock} {' '.join(words(4))} {stock} {' '.join(words(5))}") for i in range(24)]
    docs = [(d, f"{' '.join(words(20))} {stock} {' '.join(words(4))} {stock}") for d in range(60)]
    docs += [(100 + i, f"{' '.join(words(30))} {t[3:]}") for i, t in items[::3]]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = [{(r.doc_id, r.item_id) for r in leaks(d, i, block_chars=n).collect()} for n in (20_000_000, sum(len(t) for _, t in items) // 7)]
    assert got[0] == got[1] == {(100 + k, k) for k in range(0, 24, 3)}


def test_text_of_a_script_without_spaces_amid_latin_names(spark):
    zh = "记录ZH-718150显示出生地为Raspahofen，而jp_tax_notices写的是Kasraminster。Jovosh N. Larfamych曾在Lerbosund担任Mondomalis Logistics Inc.的负责人；此后无记录。"
    d = spark.createDataFrame([(1, "前言。" + zh[4:90]), (2, zh[60:75])], "doc_id long, text string")
    assert [tuple(r) for r in leaks(d, spark.createDataFrame([("a", zh)], "item_id string, text string")).collect()] == [(1, "a")]


def test_nothing_in_nothing():
    index = build_index([(1, "a b c d e f g h i j k l m n o p q")])
    assert list(candidates(index, [1], [None], np.zeros(len(index["known"]), np.int64))) == []
