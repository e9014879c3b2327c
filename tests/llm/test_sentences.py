import random

from pyspark.sql import functions as F

from pairloom.llm.sentences import blocks, labelled, fit, split_units, train, units

NAMES = ["Orar Velmig", "A. B. Norsk", "Mila Tarsen", "V. Kedrov"]
FORMS = [
    "Dr. {} signed it on 01.02.2003.", "The firm {} Inc. denies it!", "Who saw {} at No. 12?", "See p. 4 of file.json, e.g. {} there.",
    "{} scored 0.54 on the name.", "\"Who merged it?\" asked {} before leaving.", "Nobody met {} Ltd. in Borland.",
]


def corpus(rng, n, gap):
    out = []
    for _ in range(n):
        paras = [[rng.choice(FORMS).format(rng.choice(NAMES)) for _ in range(rng.randrange(1, 5))] for _ in range(3)]
        out.append(("\n\n".join(gap.join(p) for p in paras), [s for p in paras for s in p]))
    return out


def test_held_out_accuracy():
    rng = random.Random(1)
    weights = fit(labelled([t for t, _ in corpus(rng, 150, "  ") + corpus(rng, 150, " ")]))
    good = total = 0
    for text, want in corpus(rng, 100, " "):
        got = [text[a:b] for a, b in units(text, weights)]
        good += len(set(got) & set(want))
        total += len(set(want))
    assert good / total > 0.97


def test_structure():
    w = fit([])
    cut = lambda t: [t[a:b] for a, b in units(t, w)]
    assert cut("Case 12\n\nIt rained. We\nleft early.\r\n\r\n- Names: R. D. Wen\n- Country: jp\n") == [
        "Case 12", "It rained.", "We\nleft early.", "- Names: R. D. Wen", "- Country: jp",
    ]
    wrapped = "A clerk in Borland wrote on the\nMay book: it was the same person\nwrote: see below, he said, to be\nleft alone for the time. It ended."
    assert cut(wrapped) == [wrapped[:-10], "It ended."]
    assert cut("Names: A. Wen\nBirth Date: 1 May\nIt rained.") == ["Names: A. Wen", "Birth Date: 1 May", "It rained."]
    assert cut("他说：“这是同一个人。”后来没有回答。为什么？") == ["他说：“这是同一个人。”", "后来没有回答。", "为什么？"]
    assert cut("担当は「同一人物だ。」と述べた。次へ。") == ["担当は「同一人物だ。」と述べた。", "次へ。"]
    assert cut("यह बंद है। क्या वह आया?") == ["यह बंद है।", "क्या वह आया?"]
    assert cut("") == [] and cut(" \n \n ") == [] and cut("no end") == ["no end"] and cut("...") == ["..."]
    assert cut("x" * 50_000) == ["x" * 50_000]
    assert [t for t in blocks("a\n \nb c\n\n\n")] == [(0, 1), (4, 7)]


def test_spark(spark):
    rng = random.Random(2)
    texts = [t for t, _ in corpus(rng, 60, "  ")] + [None, "", "  ", "😀 Hi. Ho."]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("t", F.lit(1))
    weights = train(df)
    rows = split_units(df, weights).collect()
    ids = {r.doc_id for r in rows}
    assert ids == {*range(60), 63} and all(texts[r.doc_id][r.start_char : r.end_char].strip() for r in rows)
    assert sorted((r.start_char, r.end_char) for r in rows if r.doc_id == 63)[0][0] == 0
    assert split_units(df.limit(0), train(df.limit(0))).count() == 0
