import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pairloom.llm.encoding import VOCABULARY, encode_text, encoded, encoder, join_tokens

ODD = st.text(alphabet=st.sampled_from(list("aabbe 'srelvt \n\t12.é日本คน👍🏽ّs-")), max_size=220)


@settings(max_examples=300, deadline=None)
@given(ODD, st.integers(1, 40))
def test_tree_equals_direct(text, leaf):
    enc, _ = encoder(VOCABULARY)
    assert encode_text(text, leaf=leaf) == enc.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcdeéß日", min_size=1, max_size=200), st.integers(0, 200))
def test_join_inside_one_piece(word, at):
    enc, _ = encoder(VOCABULARY)
    b = word.encode()
    left, right = (enc._encode_single_piece(x) if x else [] for x in (b[: at % (len(b) + 1)], b[at % (len(b) + 1) :]))
    assert join_tokens(enc, left, right) == enc._encode_single_piece(b)


def test_spark_equals_other_library(spark):
    texts = ["", None, "Hello world", "it's   <|endoftext|> ok", "x" * 5000, "ab cd' re " * 700, "日本語" * 900, " " * 3000, "​ é"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, texts[5], texts[5]])], "doc_id long, text string")
    df = df.withColumn("ids", F.lit(1)).withColumn("doc_key", F.lit("k")).withColumn("no", F.lit(1))
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    rows = encoded(df, leaf=1000).collect()
    got = {r.doc_id: r.ids for r in rows}
    assert len(rows) == len(texts) + 2 and got[9] == got[5] == got[10]
    for i, x in enumerate(texts):
        assert got[i] == (t.encode(x, add_special_tokens=False).ids if x else [])
    assert encoded(df.limit(0)).count() == 0
