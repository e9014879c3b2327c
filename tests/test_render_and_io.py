import gzip
import json

import pytest
from pyspark.sql import functions as F

from pairdata import ent, pairs
from pairloom.functions import render as T
from pairloom.sources import readers as S
from pairloom.sources import writers as K
from pairloom.streaming.registry_stream import start_latest

A, B = {"id": "a", "caption": "A", "schema": "Person", "properties": {"name": ["A", "AA"], "birthDate": []}}, {"id": "b", "properties": {}}
RAW = [{"left": A, "right": B, "judgement": "positive"}, {"left": B, "right": A, "judgement": "negative"}]


def test_rendering(spark):
    rows = [(ent(name=[], alias=["x", None, "y"], address=["p", "q", "r", "s"]), ent(schema=None, name=["n"] * 9, country=["", "us"]), "positive"), (None, None, None)]
    df = pairs(spark, rows).orderBy("pair_id")
    full = [r[0] for r in df.select(T.format_entity("left")).collect()]
    assert full == ["Type: Person\nNames: \nAliases: x, y\nAddress: p; q; r", "Type: Unknown"]
    short = [r[0] for r in df.select(T.format_entity_for_prompt("right", 1)).collect()]
    assert short == ["Type: Unknown\nNames: " + ", ".join(["n"] * 8), "Type: Unknown"]
    m = df.limit(1).select(T.with_suffix_on_last_user(T.messages(("user", F.lit("a")), ("assistant", F.lit("b")), ("user", F.lit("c"))), "!").alias("m")).collect()[0].m
    assert [x.content for x in m] == ["a", "b", "c!"]
    ex = spark.createDataFrame([([("t", "positive"), ("u", "negative")],)], "e array<struct<text:string,label:string>>")
    assert ex.select(T.few_shot_block(F.col("e"))).collect()[0][0] == "Example 1:\nt\nAnswer: positive\n\nExample 2:\nu\nAnswer: negative"


def test_reasoning(spark):
    rows = [
        (ent(name=["A B"], birthDate=["1"], gender="m"), ent(name=["a b"], birthDate=["1"], gender="m"), "positive"), (ent(), ent(), "positive"),
        (ent(birthDate=["2", "1"], idNumber="x"), ent(birthDate=["3"], idNumber="y"), "negative"), (ent(name="a b"), ent(name="b c"), "negative"), (None, None, None),
    ]
    got = [r[0] for r in pairs(spark, rows).orderBy("pair_id").select(T.reasoning()).collect()]
    assert got[0] == "Same entity. Evidence: names match, birth dates match, gender matches. No contradictions found."
    assert got[1] == "Same entity. Consistent attributes, no contradictions found."
    assert got[2] == "Different entities. Conflicts: different birth dates (1 vs 3), different idNumber."
    assert got[3] == got[4] == "Different entities. Insufficient matching evidence to confirm same person."
    text = pairs(spark, rows).select(T.response()).collect()
    assert all(set(json.loads(r[0])) == {"classification", "confidence", "reasoning"} for r in text)
    with pytest.raises(ValueError):
        T.training_record("other")


def test_pair_files(spark, tmp_path):
    lines = "\n\n".join(map(json.dumps, RAW)) + "\n   \n"
    with gzip.open(tmp_path / "a.jsonl.gz", "wt") as f:
        f.write(lines)
    (tmp_path / "a.jsonl").write_text(lines)
    (tmp_path / "a.json").write_text(json.dumps(RAW, indent=1))
    (tmp_path / "s.json").write_text(json.dumps({"metadata": {"seed": 1, "target_ratio": 0.5}, "pairs": RAW}, indent=1))
    for name in ("a.jsonl.gz", "a.jsonl", "a.json", "s.json"):
        got = S.read_pairs(spark, str(tmp_path / name)).orderBy("pair_id").collect()
        assert [(r.pair_id, r.left.id, r.judgement) for r in got] == [(0, "a", "positive"), (1, "b", "negative")], name
    assert S.sample_metadata(spark, str(tmp_path / "s.json")).collect()[0].n_positive == 1
    (tmp_path / "bad.jsonl").write_text(lines + "{oops\n")
    assert S.read_jsonl(spark, str(tmp_path / "bad.jsonl"), on_error="drop").count() == 2
    kept = S.read_jsonl(spark, str(tmp_path / "bad.jsonl"), on_error="keep").collect()
    assert [r._corrupt_record for r in kept if r._corrupt_record] == ["{oops"]
    with pytest.raises(Exception, match="(?i)malformed|fail"):
        S.read_jsonl(spark, str(tmp_path / "bad.jsonl")).collect()
    cache = str(tmp_path / "silver")
    assert S.read_through(spark, str(tmp_path / "a.jsonl"), cache).where("array_contains(left_name, 'AA')").count() == 1
    (tmp_path / "a.jsonl").unlink()
    assert S.read_through(spark, str(tmp_path / "a.jsonl"), cache).count() == 2
    assert S.head_rows(spark.read.parquet(cache), 1).count() == 1


def test_ordinals_are_dense(spark):
    n = S.with_ordinal(spark.range(0, 1000, 1, 7).select(F.col("id").alias("v"))).orderBy("v").collect()
    assert [r.pair_id for r in n] == list(range(1000)) == [r.v for r in n]


def test_labels_prompts_chunks(spark, tmp_path):
    (tmp_path / "l.txt").write_text("positive\n\n negative \n")
    (tmp_path / "l.jsonl").write_text('{"judgement": "positive"}\n{"judgement": "negative"}\n')
    t, p = S.read_labels(spark, str(tmp_path / "l.txt")), S.read_labels(spark, str(tmp_path / "l.jsonl"))
    assert [r.judgement for r in t.orderBy("pair_id").collect()] == ["positive", "negative"]
    assert S.align(t, p.withColumnRenamed("judgement", "p")).where("judgement = p").count() == 2
    with pytest.raises(ValueError):
        S.align(t, p.limit(1))
    (tmp_path / "r.json").write_text(json.dumps({"prompts": [{"prompt_id": "x", "model": "m", "provenance": {"dev_f1": None}}], "metadata": {}}))
    assert S.read_prompts(spark, str(tmp_path / "r.json")).collect()[0].prompt_id == "x"
    (tmp_path / "chunk_00.json").write_text(json.dumps({"chunk_id": 0, "metrics": {"tp": 3}}))
    (tmp_path / "chunk_02.json").write_text(json.dumps({"chunk_id": 2, "metrics": {"true_positive": 4, "true_negative": 1}}))
    rows, missing = S.read_chunks(spark, str(tmp_path), 3)
    assert missing == [1] and rows.agg(F.sum("true_positive"), F.sum("true_negative")).collect()[0][:] == (7, 1)
    (tmp_path / "m.json").write_text(json.dumps({"p.predict": {"demos": [{"entity_a": "a", "classification": "positive"}, {}]}, "metadata": {}}))
    assert [(r.predictor, r.position, r.demo.entity_a) for r in S.read_demos(spark, str(tmp_path / "m.json")).collect()] == [("p.predict", 0, "a")]


def test_writers(spark, tmp_path):
    df = pairs(spark, [(ent("a"), ent("b"), "positive"), (ent("c"), None, "negative")])
    assert K.write_jsonl(df, str(tmp_path / "o")) == 2
    assert S.read_jsonl(spark, str(tmp_path / "o")).count() == 2
    K.write_sample(df, str(tmp_path / "s.json"), {"seed": 1, "note": "é"})
    assert [r.left.id for r in S.read_pairs(spark, str(tmp_path / "s.json")).orderBy("pair_id").collect()] == ["a", "c"]
    K.write_training(df.withColumn("split", F.lit("train")), str(tmp_path / "t"))
    back = spark.read.text(str(tmp_path / "t"))
    assert {(r.split, r.format): r["count"] for r in back.groupBy("split", "format").count().collect()} == {("train", k): 2 for k in ("openai", "alpaca", "sharegpt")}
    t = spark.createDataFrame([("m", 0.5), (None, None)], "model string, f1 double")
    assert K.markdown(t).splitlines()[2] == "| m | 50.00% |"
    assert json.loads(K.document(t, "runs").collect()[0].value)["runs"][1]["f1"] == 0.5
    assert K.patch_document({"a": 1, "b": 2}, ["a"], {"b": 0, "c": 3}, {"d": 4}) == {"b": 2, "c": 3, "d": 4}


def test_published_layout(spark, tmp_path):
    df = pairs(spark, [(ent("a"), ent("b"), "positive")]).drop("pair_id")
    for s in ("train", "test"):
        df.write.parquet(str(tmp_path / "default" / s))
    assert sorted(r.split for r in S.read_published(spark, str(tmp_path)).collect()) == ["test", "train"]


def test_stream_of_experiments(spark, tmp_path):
    folder = tmp_path / "runs"
    folder.mkdir()
    (folder / "1.json").write_text('{"run_id": "r1", "timestamp": "2025-01-01", "method": "m", "metrics": {"f1": 0.1}}\n')
    start_latest(spark, str(folder), str(tmp_path / "cp"), "v1").awaitTermination(60)
    (folder / "2.json").write_text('{"run_id": "r2", "timestamp": "2025-02-01", "method": "m", "metrics": {"f1": 0.2}}\n{"run_id": "r0", "timestamp": "2024-01-01", "method": "m"}\n')
    start_latest(spark, str(folder), str(tmp_path / "cp2"), "v2").awaitTermination(60)
    assert [(r.method, r.run_id) for r in spark.table("v2").collect()] == [("m", "r2")]
