"""Queries p5: evaluation pairs that occur again, exactly or almost, in the training split.

A pair is the set of its shingles: runs of five words, or the whole of a shorter value, in each value of its two records,
tagged with the field; ids, judgement, side and the last listing date don't count. The join is exact: with a common
order of shingles, rare ones first, two sets of Jaccard similarity t or more share one of their first
``n - ceil(t n) + 1`` shingles. The evaluation side's prefixes are the index that training prefixes probe; length and
position filters drop hopeless candidates, the rest is verified on the whole sets and, side by side, on the two records.
Pairs of equal content are one class: only classes are joined, and members come back at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm.textforms import loose
from pairloom.session import Scratch, table

WORDS = 5
#: Jaccard similarity of the pairs' shingles, and least similarity of the records that face each other.
SIMILARITY, RECORD_SIMILARITY = 0.8, 0.6
EVALUATION, TRAINING = ("val", "test"), "train"
#: Shingles are ordered by the count of their bucket, of which there are 2 to this power; ties by hash.
ORDER_BITS = 18


def record_shingles(e: str) -> Column:
    """The distinct 64-bit shingles of one record. A null record, or one without any content, has none."""
    one = lambda tag, c: F.struct(F.lit(tag).alias("k"), F.array(c).alias("v"))
    props = F.transform(
        F.map_entries(F.coalesce(F.col(f"{e}.properties"), F.create_map().cast("map<string,array<string>>"))),
        lambda x: F.struct(x["key"].alias("k"), x["value"].alias("v")),
    )
    datasets = F.struct(F.lit("datasets").alias("k"), F.col(f"{e}.datasets").alias("v"))
    fixed = [one(c, F.col(f"{e}.{c}")) for c in ("caption", "schema", "first_seen")]
    fields = F.concat(F.array(*fixed, datasets), props)

    # a lambda's argument is evaluated once, an expression at each use: values are cut into words in a lambda's argument
    def runs(k: Column, words: Column) -> Column:
        of = lambda i: F.xxhash64(k, F.slice(words, i, F.lit(WORDS)))
        starts = F.sequence(F.lit(1), F.size(words) - (WORDS - 1))
        return F.when(F.size(words) <= WORDS, F.array(F.xxhash64(k, words))).otherwise(F.transform(starts, of))

    def of_field(f: Column) -> Column:
        values = F.array_compact(F.coalesce(f["v"], F.array().cast("array<string>")))
        words = F.transform(values, lambda v: F.filter(F.split(loose(v), " "), lambda w: w != ""))
        return F.flatten(F.transform(F.filter(words, lambda w: F.size(w) > 0), lambda w: runs(f["k"], w)))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(fields, of_field))))


def known_splits(splits: DataFrame) -> DataFrame:
    """``pair_id``, ``split``, distinct: the splits that take part, without case and surrounding blanks."""
    s = splits.select("pair_id", F.lower(F.trim("split")).alias("split"))
    return s.where(F.col("split").isin(TRAINING, *EVALUATION)).distinct()


def pair_classes(pairs: DataFrame, splits: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Members ``(pair_id, split, c1, c2)`` and classes ``(c1, c2, a, b, in_eval, in_train)`` of pairs of equal content.

    Classes are named by 128 bits of hash over both records' shingles, whichever side they stand on. The shingles of all
    pairs are written where they are made; only those of one pair of each class travel.
    """
    sets = pairs.select("pair_id", record_shingles("left").alias("a"), record_shingles("right").alias("b"))
    sets = sets.where((F.size("a") > 0) | (F.size("b") > 0))
    h = lambda seed, c: F.xxhash64(F.lit(seed), c)
    names = [(F.least(h(s, "a"), h(s, "b")), F.greatest(h(s, "a"), h(s, "b"))) for s in (1, 2)]
    sets = scratch.save(sets.select("pair_id", "a", "b", *[F.xxhash64(lo, hi).alias(f"c{i}") for i, (lo, hi) in enumerate(names, 1)]), "sets")
    members = scratch.save(sets.select("pair_id", "c1", "c2").join(known_splits(splits), "pair_id"), "members")
    evals = F.col("split").isin(*EVALUATION)
    firsts = members.groupBy("c1", "c2").agg(
        F.min("pair_id").alias("pair_id"), F.bool_or(evals).alias("in_eval"), F.bool_or(~evals).alias("in_train")
    )
    # a pair_id may stand in several rows, of equal or other content
    classes = sets.join(firsts, ["pair_id", "c1", "c2"]).dropDuplicates(["pair_id", "c1", "c2"])
    classes = scratch.save(classes.select("c1", "c2", "a", "b", "in_eval", "in_train"), "classes")
    scratch.drop(sets)
    return members, classes


def prefixes(sets: DataFrame, t: float) -> DataFrame:
    """The first shingles of each set, rare ones first: ``token, pos, n`` and the set's other columns. Numpy over Arrow.

    How often shingles occur is counted over all sets in ``2 ** ORDER_BITS`` buckets of their hash, a table of that size
    whatever the data's. Any order keeps the join exact, as long as it is the same for all sets.
    """
    import numpy as np

    bucket = F.col("token").bitwiseAND(F.lit((1 << ORDER_BITS) - 1)).cast("int").alias("bucket")
    rows = sets.select(F.explode("set").alias("token")).groupBy(bucket).agg(F.count(F.lit(1)).alias("n_rows")).toArrow()
    counts = np.zeros(1 << ORDER_BITS, np.int64)
    counts[rows["bucket"].to_numpy()] = rows["n_rows"].to_numpy()
    known = sets.sparkSession.sparkContext.broadcast(counts)
    rest = [c for c in sets.columns if c != "set"]

    def run(batches):
        import pyarrow as pa

        n_of, mask = known.value, (1 << ORDER_BITS) - 1
        for batch in batches:
            col = batch.column("set")
            offsets = col.offsets.to_numpy()
            flat = col.values.to_numpy()[offsets[0] : offsets[-1]]
            lengths = np.diff(offsets)
            row = np.repeat(np.arange(len(lengths)), lengths)
            ranked = np.lexsort((flat, n_of[flat & mask], row))
            pos = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            keep = pos < (lengths - np.ceil(lengths * t - 1e-9) + 1).astype(np.int64)[row]
            picked = pa.array(row[ranked][keep])
            arrays = [pa.array(flat[ranked][keep]), pa.array(pos[keep].astype(np.int32)), pa.array(lengths[row][keep].astype(np.int32))]
            arrays += [batch.column(c).take(picked) for c in rest]
            yield pa.RecordBatch.from_arrays(arrays, names=["token", "pos", "n", *rest])

    kinds = dict(sets.dtypes)
    return sets.mapInArrow(run, ", ".join(["token long, pos int, n int", *[f"`{c}` {kinds[c]}" for c in rest]]))


def cross_split_overlaps(
    pairs: DataFrame, splits: DataFrame, t: float = SIMILARITY, record_t: float = RECORD_SIMILARITY
) -> DataFrame:
    """``eval_id``, ``eval_split``, ``train_id``: pairs of val or test that training has too, the same or almost.

    Pairs without a known split take no part; a pair with two splits counts in both, never against itself. Null records
    have no shingles; pairs of two such records overlap nothing. Rows repeated under another id are pairs of their own.
    """
    scratch = Scratch(pairs.sparkSession, "overlaps")
    members, classes = pair_classes(pairs, splits, scratch)
    both = classes.withColumn("set", F.array_sort(F.array_union("a", "b")))
    firsts = scratch.save(prefixes(both.select("set", "c1", "c2", "in_eval", "in_train"), t), "prefixes")
    index = firsts.where("in_eval").select("token", *[F.col(c).alias(f"e_{c}") for c in ("pos", "n", "c1", "c2")])
    probe = firsts.where("in_train").select("token", *[F.col(c).alias(f"t_{c}") for c in ("pos", "n", "c1", "c2")])
    most = F.least(F.col("e_n") - F.col("e_pos"), F.col("t_n") - F.col("t_pos"))
    need = F.ceil((F.col("e_n") + F.col("t_n")) * F.lit(t / (1 + t)) - F.lit(1e-9))
    near = probe.join(index, "token").where(
        (F.col("t_n") >= F.col("e_n") * t - 1e-9) & (F.col("e_n") >= F.col("t_n") * t - 1e-9) & (most >= need)
    )
    found = scratch.save(near.select("e_c1", "e_c2", "t_c1", "t_c2").distinct(), "candidates")
    scratch.drop(firsts)
    e = classes.select(F.col("c1").alias("e_c1"), F.col("c2").alias("e_c2"), F.col("a").alias("ea"), F.col("b").alias("eb"))
    c = classes.select(F.col("c1").alias("t_c1"), F.col("c2").alias("t_c2"), F.col("a").alias("ta"), F.col("b").alias("tb"))
    sets = found.join(e, ["e_c1", "e_c2"]).join(c, ["t_c1", "t_c2"])

    def alike(x: Column, y: Column) -> Column:
        common_ = F.size(F.array_intersect(x, y))
        union = F.size(x) + F.size(y) - common_
        return F.when(union == 0, F.lit(1.0)).otherwise(common_ / union)

    straight = F.least(alike(F.col("ea"), F.col("ta")), alike(F.col("eb"), F.col("tb")))
    crossed = F.least(alike(F.col("ea"), F.col("tb")), alike(F.col("eb"), F.col("ta")))
    whole = alike(F.array_union("ea", "eb"), F.array_union("ta", "tb"))
    same = sets.where((whole >= t - 1e-9) & (F.greatest(straight, crossed) >= record_t - 1e-9))
    same = scratch.save(same.select("e_c1", "e_c2", "t_c1", "t_c2"), "same")
    evals = members.where(F.col("split").isin(*EVALUATION)).select(
        F.col("pair_id").alias("eval_id"), F.col("split").alias("eval_split"), F.col("c1").alias("e_c1"), F.col("c2").alias("e_c2")
    )
    train = members.where(F.col("split") == TRAINING).select(
        F.col("pair_id").alias("train_id"), F.col("c1").alias("t_c1"), F.col("c2").alias("t_c2")
    )
    out = evals.join(same, ["e_c1", "e_c2"]).join(train, ["t_c1", "t_c2"]).where("eval_id <> train_id")
    return out.select("eval_id", "eval_split", "train_id").distinct()


def p5_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_split_overlaps(table(spark, sf_dir, "pairs"), table(spark, sf_dir, "pair_splits"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = p5_overlaps(spark, sf_dir)
    return o.select(F.least("eval_id", "train_id").alias("pair_id_a"), F.greatest("eval_id", "train_id").alias("pair_id_b")).distinct()


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per split and dataset: evaluation pairs, and those that training has too. A pair counts once for a dataset."""
    pairs, splits = table(spark, sf_dir, "pairs"), table(spark, sf_dir, "pair_splits")
    hit = p5_overlaps(spark, sf_dir).select(F.col("eval_id").alias("pair_id"), F.col("eval_split").alias("split")).distinct()
    names = F.array_union(
        F.coalesce("left.datasets", F.array().cast("array<string>")), F.coalesce("right.datasets", F.array().cast("array<string>"))
    )
    evals = known_splits(splits).where(F.col("split") != TRAINING)
    rows = pairs.select("pair_id", F.explode(names).alias("dataset")).join(evals, "pair_id")
    marked = rows.join(hit.withColumn("hit", F.lit(1)), ["pair_id", "split"], "left")
    return marked.groupBy("split", "dataset").agg(F.count("*").alias("n_pairs"), F.count("hit").alias("n_overlapping"))


QUERIES = {"p5_found": p5_found, "p5_report": p5_report}
SQL: dict[str, str] = {}
