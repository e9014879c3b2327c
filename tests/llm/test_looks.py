from pyspark.sql import functions as F

from pairdata import ent, pairs
from pairloom.llm.looks import name_values, same_look, with_form
from pairloom.llm.textforms import multi_forms, single_forms

CASES = [
    ("Наrаr Gölсаlеrѕ", "Harar Gölcalers"), ("Ｎｅｌｂ Ｉｎｖ．", "Nelb Inv."), ("a​b­c﻿", "abc"),
    ("Göl", "Göl"), ("x y　z q", "x y z q"), ("ﬁn", "fin"), ("𝐀ﬃx", "Affix"), ("  two  blanks ", "two blanks"),
    ("", ""), (None, None), ("МОΝΑ", "MONA"), ("é‍e", "ée"), ("plain", "plain"), ("Ё'", "Ë'"), ("東京", "東京"),
    ("e" * 20000 + "​", "e" * 20000), ("quo'te \"x\"", "quo'te \"x\""),
]


def test_forms(spark):
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(CASES)], 'n int, "my value" string'.replace('"my value"', "v"))
    got = {r.n: r.f for r in with_form(df.withColumn("f", F.lit(3)), "v", "f").collect()}
    assert [got[i] for i in range(len(CASES))] == [b for _, b in CASES]


def test_tables_don_t_chain():
    forms = single_forms()
    assert not set("".join(forms.values())) & set(forms) and not set("".join(multi_forms().values())) & (set(forms) | set(multi_forms()))
    assert not any(c.isascii() and c.isprintable() for c in forms)


def test_pairs_of_ids(spark):
    rows = [
        (ent("a", "Harar"), ent("b", "Наrаr", name=["other", None, ""]), "positive"),
        (ent("c", "Harar"), ent("d", "HARAR", alias=["harar"]), "negative"),
        (ent("a", None, name=["Harar​"]), ent("e", "other"), None), (None, ent("", "Harar"), None),
    ]
    df = pairs(spark, rows).withColumn("value", F.lit(0)).withColumn("id", F.lit(0))
    got = sorted((r.id_a, r.id_b) for r in same_look(name_values(df)).collect())
    assert got == [("a", "b"), ("a", "c"), ("b", "c")]
    assert same_look(name_values(df.limit(0))).count() == 0
