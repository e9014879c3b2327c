"""Units of the core: text, similarity, metrics, profiles, ranks, checks."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from pairdata import ent, pairs
from pairloom.functions import text as X
from pairloom.functions.similarity import name_similarity, shared_fields, similarity_score, values_overlap
from pairloom.operators import entities as E
from pairloom.operators import metrics as M
from pairloom.operators import profile as P
from pairloom.operators import ranking as R
from pairloom.operators import registry as G
from pairloom.operators import validate as V
from pairloom.operators.predict import agreement_predictor, predict, two_stage


def one(df):
    return df.collect()[0][0]


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_text(spark):
    assert column(spark, ["  Smith　John ", None, ""], X.normalize_text) == ["smith　john", "", ""]
    assert column(spark, ["Smith John", "john smith ", None], X.token_key) == ["john smith", "john smith", ""]
    assert column(spark, [["1962-11-11", " 1962", "x", "", None]], X.years, "array<string>") == [["1962", "1962"]]
    found = column(spark, ["Иван Ivan", "123", "東京", "é[", None], X.scripts)
    assert found == [["Cyrillic", "Latin"], [], ["CJK"], ["Latin"], []]
    assert column(spark, ["Иван Ivan", "1"], lambda c: X.primary_script(X.scripts(c))) == ["Cyrillic", "Unknown"]
    names = ["us_ofac", "wikidata", "interpol", "ES_x"]
    assert column(spark, names, X.country_extended) == ["United States", X.ELSEWHERE, "India", "Spain"]
    assert column(spark, names, X.country_basic) == ["United States", X.ELSEWHERE, X.ELSEWHERE, X.ELSEWHERE]
    assert column(spark, ["Not positive", "negative", "dunno", None], X.parse_label) == ["positive", "negative", "negative", "negative"]
    assert column(spark, ["gpt-4.1-mini", "gpt-5-nano", "Llama-3", "deepseek-r1", "m-1", None], X.display_name) == ["GPT-4.1", "GPT-5-nano", "Llama-8B", "DeepSeek-14B", "m-1", "Unknown"]


def test_scores(spark):
    rows = [
        (ent(name="A B", country="us"), ent(name="b  a", nationality="US "), None), (ent(name="A B", birthDate="1962-11-11"), ent(name="a b", birthDate=["1962-11-11"]), None),
        (ent(birthDate="1962-11-11"), ent(birthDate="1962"), None), (ent(country=[" "]), ent(country=[""]), None), (None, None, None), (ent(name=[]), ent(name=["x"]), None),
    ]
    got = [r[0] for r in pairs(spark, rows).orderBy("pair_id").select(similarity_score()).collect()]
    assert got == [0.7999999999999999, 0.8999999999999999, 0.1, 0.1, 0.0, 0.0]
    a = spark.createDataFrame([([" "], [""])], "l array<string>, r array<string>")
    assert one(a.select(values_overlap(F.col("l"), F.col("r")))) is True
    f = pairs(spark, [(ent(name=["x", "y"], alias=["q"], notes=None), ent(name=["y"], alias=["z"], notes=["n"]), None)])
    assert one(f.select(shared_fields())) == ["name"]


def test_ratio_equals_difflib(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randrange(0, 9)))
    rows = [([word() for _ in range(rng.randrange(4))], [word() for _ in range(rng.randrange(4))]) for _ in range(150)]
    rows += [(["tide"], ["diet"]), (["diet"], ["tide"]), (["ab " * 90], ["ba " * 80 + "c"])]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, l array<string>, r array<string>")
    got = [r[0] for r in df.orderBy("i").select(name_similarity(F.col("l"), F.col("r"))).collect()]
    key = lambda s: " ".join(sorted(s.split()))
    want = [max((SequenceMatcher(None, key(x), key(y)).ratio() for x in a for y in b), default=0.0) for a, b in rows]
    assert got == pytest.approx(want) and got[150:152] == [0.25, 0.5]


def test_metrics(spark):
    df = spark.createDataFrame([("positive", "negative", 0.3), ("negative", None, 0.3), (None, "error", 0.1)], "t string, p string, s double")
    r = M.evaluate(df, "t", "p").collect()[0]
    assert (r.true_positive, r.false_positive, r.false_negative, r.true_negative, r.precision, r.f1) == (0, 0, 1, 2, 0.0, 0.0)
    assert M.evaluate(df.limit(0), "t", "p").collect()[0].accuracy == 0.0
    swept = M.threshold_counts(df, "s", "t", [0.1, 0.2, 0.5])
    by = {r.threshold: r for r in swept.collect()}
    assert (by[0.1].true_positive, by[0.1].false_positive, by[0.2].false_positive, by[0.5].true_positive) == (1, 2, 1, 0)
    assert M.best_threshold(swept).collect()[0].threshold == 0.2
    none = M.best_threshold(M.threshold_counts(df.where("t is null"), "s", "t", [0.1, 0.2]))
    assert none.collect()[0].threshold == 0.5
    parts = df.withColumn("c", F.monotonically_increasing_id()).groupBy("c").agg(*M.confusion(F.col("t"), F.col("p")))
    assert M.merge_partials(parts).collect()[0].asDict() == r.asDict()
    c = spark.createDataFrame([("positive",), ("error",), ("uncertain",), ("negative",)], "p string")
    assert M.coverage(c, "p").collect()[0].coverage == pytest.approx(2 / 3)
    m = spark.createDataFrame([(" Negative", "negative "), ("positive", "POSITIVE"), (None, None), ("a", "b")], "t string, p string")
    assert [r[0] for r in m.select(M.weighted_match(F.col("t"), F.col("p"))).collect()] == [1.5, 1.0, 0.0, 0.0]


def test_profiles(spark):
    v = lambda xs: spark.createDataFrame([(x,) for x in xs], "x long")
    r = P.describe(v([1, 2, 3, 4, None]), "x").collect()[0]
    assert (r.n, r.mean, r["median"], r.p25, r.p75, r["max"], r["min"]) == (4, 2.5, 2.5, 2, 4, 4, 1)
    rng = random.Random(2)
    for n in (1, 2, 5, 6, 7, 33):
        xs = [rng.randrange(9) for _ in range(n)]
        s = sorted(xs)
        r = P.describe(v(xs), "x").collect()[0]
        assert (r.p25, r.p75) == (s[n // 4], s[min(n - 1, 3 * n // 4)]) and r["median"] == (s[(n - 1) // 2] + s[n // 2]) / 2
    for xs, want in (([1, 1, 1, 1], 0.0), ([0, 0, 0, 4], 0.75), ([], 0.0), ([0, 0], 0.0), ([1, 2, 2, 5], None)):
        s, n = sorted(xs), len(xs)
        want = want if want is not None else 2 * sum((i + 1) * x for i, x in enumerate(s)) / (n * sum(s)) - (n + 1) / n
        assert one(P.gini(v(xs), "x")) == pytest.approx(want)
    c = spark.createDataFrame([(["a"], ["b"]), (["a"], ["a", "b"]), ([], ["a"]), (None, ["a"])], "l array<string>, r array<string>")
    assert [r[0] for r in c.select(P.cross_source(F.col("l"), F.col("r"))).collect()] == [True, False, False, False]


def test_first_seen_and_incidence(spark):
    rows = [(ent("y"), ent("x", schema="A"), None), (ent("x", schema="B"), ent("x"), None), (ent(None), None, None)]
    df = pairs(spark, rows).withColumn("e", F.lit(1)).withColumn("side", F.lit(5))
    assert {r.id: r.e.schema for r in E.first_seen(df).collect()} == {"x": "A", "y": "Person"}
    assert sorted(map(tuple, E.incidence(df).collect())) == [(0, "x"), (0, "y"), (1, "x")]


def test_ranks_and_samples(spark):
    df = spark.range(500).select(F.col("id"), F.when(F.col("id") % 4 > 0, "positive").otherwise("negative").alias("j"))
    r = R.ranked(df.withColumn("h", R.hash_order(1, F.col("id"))), "h", "id", "j", digits=1).collect()
    for j in ("positive", "negative"):
        mine = sorted((x for x in r if x.j == j), key=lambda x: (x.h, x.id))
        assert [x["rank"] for x in mine] == list(range(len(mine)))
    s = R.stratified_sample(df, "j", {"positive": 77, "negative": 23}, "id")
    assert {x.j: x["count"] for x in s.groupBy("j").count().collect()} == {"positive": 77, "negative": 23}
    with pytest.raises(ValueError, match="not enough"):
        R.stratified_sample(df, "j", {"negative": 126}, "id")
    assert R.stratified_sample(df, "j", {"negative": 126}, "id", strict=False).count() == 125
    rows = [(ent(schema=s), ent(), j) for s, j, n in (("Person", "positive", 40), ("Company", "positive", 2), (None, "negative", 30)) for _ in range(n)]
    d = R.diverse_selection(pairs(spark, rows), 16).collect()
    assert sum(x.judgement == "positive" for x in d) == 10 and len(d) == 16 and sum(x.is_person for x in d) == 8
    assert sorted(x.chunk for x in R.chunked(spark.range(10), "id", 10, 4).collect()) == [0, 0, 1, 1, 2, 2, 3, 3, 3, 3]
    a = spark.createDataFrame([(1, None), (1, None), (2, "x")], "k int, v string")
    assert [tuple(r) for r in R.minus_by_value(a, a.where("k = 1"), ["k", "v"]).collect()] == [(2, "x")]


def test_entity_split_modes(spark):
    rows = [(ent(f"a{i}"), ent(f"a{(i * 7 + 3) % 40}"), "positive") for i in range(40)] + [(ent("a1"), ent(None), None)]
    df = pairs(spark, rows)
    ref = {r.pair_id: r.split for r in R.entity_split(df, (0.5, 0.2)).collect()}
    strict = {r.pair_id: r.split for r in R.entity_split(df, (0.5, 0.2), strict=True).collect()}
    assert len(ref) == 41 and ref[40] == "train" and 40 not in strict and set(strict) < set(ref)
    assert all(ref[k] == v for k, v in strict.items())
    sp = spark.createDataFrame(list(strict.items()), "pair_id long, split string")
    assert R.split_overlap(df, sp).count() == 0


def test_checks(spark):
    seq = lambda s: spark.createDataFrame([(i, c) for i, c in enumerate(s)], "i long, v string")
    for s, want in (("PPNP", 3), ("", 0), ("P", 1), ("PNNNPPPPNP" * 3, None)):
        want = want if want is not None else 1 + sum(a != b for a, b in zip(s, s[1:]))
        assert one(V.run_count(seq(s), "i", "v", block=3)) == want
    labels = ["positive" if i % 2 or i >= 100 else "negative" for i in range(250)]
    w = V.windows_with_both(spark.createDataFrame(list(enumerate(labels)), "i long, v string"), "i", "v").collect()[0]
    assert (w.n_windows, w.n_both) == (2, 1)
    ok = V.validate_sample(spark.createDataFrame([(0, "positive"), (1, "negative")], "i long, v string"), "i", "v", 0.5).collect()[0]
    assert ok.ratio_ok and ok.n_runs == 2 and ok.shuffled
    j = spark.createDataFrame([('{"k": 1}',), ("{}",), ("{x",), (None,)], "s string")
    r = V.check_json(j, "s", ["k"]).collect()[0]
    assert (r.n, r.n_broken, r.lacks_k, r.valid) == (3, 1, 1, False)
    assert V.check_json(j.where("s like '{}'"), "s", ["k"]).collect()[0].valid is True
    assert V.check_json(j.where("s like '{}'"), "s", ["k"], keys_matter=True).collect()[0].valid is False


def test_digests(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x")
    got = V.file_digests(spark, str(tmp_path / "a.txt"))
    assert V.check_digests(got, got).collect()[0].ok
    assert not V.check_digests(got, got.withColumn("sha256", F.lit("0"))).collect()[0].ok


def test_registry(spark):
    p = spark.createDataFrame([("a", "m", 0, (None,)), ("b", "m", 1, (0.5,)), ("c", "m", 2, (0.5,)), ("d", "n", 3, (None,))], "prompt_id string, model string, position int, provenance struct<dev_f1:double>")
    assert {r.model: (r.prompt_id, r.score) for r in G.best_prompt(p).collect()} == {"m": ("b", 0.5), "n": ("d", 0.0)}
    x = spark.createDataFrame([("k", "1", 1), ("k", "2", 2), (None, "1", 3)], "k string, t string, v int")
    assert sorted(r.v for r in G.latest_per(x, "k", "t", "v").collect()) == [2, 3]
    assert sorted(r.v for r in G.upsert(x, x.where("v = 2").withColumn("v", F.lit(9)), "k").collect()) == [3, 9]


def test_predictors(spark):
    df = pairs(spark, [(ent(caption="a b"), ent(caption="B c"), None), (ent(caption="a"), None, None)])
    assert [r.classification for r in predict(df, agreement_predictor).orderBy("pair_id").collect()] == ["positive", "negative"]

    def fails(batch):
        raise RuntimeError("no model")

    bad = predict(df, fails).collect()
    assert {r.classification for r in bad} == {"error"} and bad[0].error == "no model"
    assert {r.error for r in predict(df, lambda b: ["maybe"] * len(b)).collect()} == {"unknown class"}
    assert {r.classification for r in two_stage(df, fails, agreement_predictor).collect()} == {"positive", "negative"}
