import json

import pytest
from pyspark.sql import functions as F

from pairdata import ent, pairs
from pairloom.functions import render as T
from pairloom.functions.text import names_of
from pairloom.operators import examples as E
from pairloom.operators import metrics as M
from pairloom.operators import predict as A
from pairloom.operators import registry as G
from pairloom.sources import readers as S
from pairloom.sources import writers as K


def test_names_in_their_order(spark):
    df = pairs(spark, [(ent(weakAlias="w", middleName="m", lastName="l", firstName="f", alias=["a", " "], name=["n", None]), None, None)])
    assert df.select(names_of("left")).collect()[0][0] == ["n", "a", "f", "l", "m", "w"]


def test_selections(spark):
    df = pairs(spark, [(ent(f"a{i}", country="us"), ent(f"b{i}"), ["positive", "negative", None][i % 3]) for i in range(60)])
    assert E.select_random(df, 7).count() == 7 and E.select_random(df, 900).count() == 60
    out = df.where("pair_id < 30")
    got = E.select_balanced(df, 9, out).collect()
    assert [r.judgement for r in got].count("positive") == 4 and len(got) == 9 and all(r.pair_id >= 30 for r in got)
    none = df.limit(0)
    assert E.select_balanced(none, 4).count() == 0 == E.select_random(none, 3).count()
    assert E.select_examples(df, "curated", 8, none).count() == 8
    assert [r.pair_id for r in E.select_examples(df, "curated", 2, df).collect()] == [0, 1]
    with pytest.raises(ValueError):
        E.select_examples(df, "best", 1)
    r = E.examine(df.where("pair_id < 6")).collect()[0]
    assert (r.total, r.positive, r.negative, r.has_country, r.has_birthDate) == (6, 2, 4, 6, 0)
    assert E.examine(none).collect()[0].positive_ratio == 0.0
    assert {r.part: r["count"] for r in E.prefix_split(df, "pair_id", 60).groupBy("part").count().collect()} == {"tune": 48, "validate": 12}


def test_grid_and_batches(spark):
    df = spark.createDataFrame([("positive", "positive", 0.9, None), ("negative", "error", 0.8, "boom"), (None, "positive", 0.1, None), ("negative", None, 0.2, None)], "t string, p string, s double, e string")
    g = E.grid_metrics(df, "t", {"low": F.col("s") >= 0.5, "high": F.col("s") >= 0.85})
    assert E.best_candidate(g).collect()[0].candidate == "high"
    r = M.evaluate_batch(df, "t", "p", "e").collect()[0]
    assert (r.n_evaluated, r.n_errors, r.true_positive, r.accuracy) == (1, 1, 1, 1.0)


def test_answers(spark):
    raws = ['{"classification": "positive", "confidence": "high", "reasoning": "é"}', '{"classification": "maybe"}', "oops", None, "{}"]
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw string").orderBy("i").select(A.parse_response(F.col("raw")).alias("r")).collect()
    assert [x.r.classification for x in rows] == ["positive", "error", "error", "error", "error"]
    assert rows[0].r.error is None and rows[1].r.error == "unknown class: maybe" and rows[3].r.error == "no response"
    u = spark.createDataFrame([((3, 4, 7),)], "u struct<prompt_tokens:int,completion_tokens:int,total_tokens:int>")
    assert u.select(A.tokens_used(F.col("u"))).collect()[0][0][:] == (3, 4, 7)


def test_prompts(spark):
    p = spark.createDataFrame([(0, "x", "m", "f/x", 0.5), (1, "y", "all", "f/y", None), (2, "z", "all", None, 0.2)], "position int, prompt_id string, model string, path string, f double")
    p = p.select("position", "prompt_id", "model", "path", F.struct(F.col("f").alias("dev_f1"), F.lit("o").alias("optimizer")).alias("provenance"))
    asked = spark.createDataFrame([("m",), ("new",)], "model string")
    assert {r.model: r.prompt_id for r in G.prompt_for(asked, p).collect()} == {"m": "x", "new": "z"}
    assert {r.model: r.prompt_id for r in G.prompt_for(asked, p.where("model = 'm'")).collect()} == {"m": "x", "new": None}
    files = spark.createDataFrame([("f/x", "text of x")], "path string, text string")
    assert G.load_prompt(p, files, "x") == G.load_prompt(p, files, "f/x") == "text of x"
    with pytest.raises(FileNotFoundError):
        G.load_prompt(p, files, "y")
    assert G.prompts_of(p, model="all", optimizer="o").count() == 2 and G.with_files(p, files).count() == 1


def test_examples_in_prompts(spark):
    df = spark.createDataFrame([([("A", "B", "positive", None)],), ([],)], "e array<struct<a:string,b:string,label:string,reasoning:string>>")
    got = [r[0] for r in df.select(T.numbered_examples(F.col("e"))).collect()]
    assert got[0].startswith("Here are some examples:\n\nExample 1:\n=== ENTITY A ===\nA\n") and T.NO_REASON in got[0] and got[1] == ""
    assert "=== EXAMPLE ===\nENTITY A:\nA" in df.select(T.titled_examples(F.col("e"))).collect()[0][0]
    m = df.select(T.request(F.lit("u"), "s", True).alias("m")).collect()[0].m
    assert [(x.role, x.content) for x in m] == [("developer", "s"), ("user", "u")]
    rows = [(ent(name="a", gender="m"), ent(name="b", gender="f"), "positive"), (ent(gender="m", birthDate="1"), ent(gender="f", birthDate="1"), "negative"), (None, None, None)]
    assert [r[0] for r in pairs(spark, rows).orderBy("pair_id").select(T.short_reasoning()).collect()] == [
        "No contradictions found. Names match or are variations. Same entity.", "Contradictions found: different genders. Different entities.", T.SHORT_NEGATIVE[1],
    ]


def test_answers_escape_letters_beyond_ascii(spark):
    texts = ["é \"x\"", "東京", "😀 a\n", "plain", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    assert [r[0] for r in df.select(T.json_text(F.col("t"))).collect()] == [json.dumps(t) for t in texts]


def test_ordinals_follow_the_files(spark, tmp_path):
    n = 0
    for name, size in (("a", 3), ("b", 3000), ("c", 30000)):
        (tmp_path / f"{name}.jsonl").write_text("".join(f'{{"judgement": "{i}"}}\n' for i in range(n, n + size)))
        n += size
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "60000")
    try:
        assert S.read_labels(spark, str(tmp_path)).where("pair_id <> cast(judgement as long)").count() == 0
        assert S.read_labels(spark, str(tmp_path)).agg(F.count_distinct("pair_id")).collect()[0][0] == n
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_missing_files(spark, tmp_path):
    assert S.read_prompts(spark, str(tmp_path / "none.json")).count() == 0
    assert S.read_curated(spark, str(tmp_path / "none.json")).count() == 0
    one = {"left": {"id": "a"}, "right": {"id": "b"}, "judgement": "positive"}
    (tmp_path / "c.json").write_text(json.dumps({"examples": [one, one]}))
    (tmp_path / "l.json").write_text(json.dumps([one, one, one]))
    assert S.read_curated(spark, str(tmp_path / "c.json"), 1).count() == 1 and S.read_curated(spark, str(tmp_path / "l.json")).count() == 3
    (tmp_path / "raw.jsonl").write_text(json.dumps(one) + "\n")
    assert S.read_test_pairs(spark, str(tmp_path / "none.jsonl"), str(tmp_path / "raw.jsonl"), 5).count() == 1
    (tmp_path / "m.json").write_text(json.dumps({"checksums": {"x": "y"}}))
    assert [tuple(r) for r in S.read_checksums(spark, str(tmp_path / "m.json")).collect()] == [("x", "y")]
    K.write_chunks(spark.createDataFrame([(0, 1, 2), (3, 4, 5)], "chunk_id long, true_positive long, true_negative long"), str(tmp_path / "ch"))
    rows, missing = S.read_chunks(spark, str(tmp_path / "ch"), 4)
    assert missing == [1, 2] and rows.agg(F.sum("true_negative")).collect()[0][0] == 7
