"""Queries p8: the whole corpus as ids of a public byte-level BPE vocabulary, exact for texts of any length.

Texts up to a leaf's length are encoded where they lie, without a shuffle. Longer ones are cut into leaves that are
encoded in parallel and joined pairwise, level by level, so no task but the last sees a whole text. A join re-encodes a
window around the cut, which grows until both sides agree:

* Pieces: the vocabulary's pattern cuts text into pieces from left to right without looking back, so a piece of the left
  part that ends a few characters before the cut is final, and once the scan over the cut meets a piece boundary of the
  right part, all that follows is the right part's own.
* A piece longer than the cut, such as one huge run of letters, is joined on its tokens: a token sequence is the BPE
  encoding of its bytes exactly if each two neighbours are, so a re-encoded window that keeps its first and its last
  token can be put between the rest of both sides.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.session import spread, table

#: The dealt vocabulary: its file name below the folder of public vocabularies.
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Longest text in characters that is encoded in one go; longer ones are cut into leaves of this length.
LEAF_CHARS = 65_536
#: The vocabulary's pattern looks at most this many characters past the end of a piece.
LOOK_AHEAD = 4

_STATE = "doc_key string, no long, text string, ids array<int>, ends array<long>"


@lru_cache(maxsize=4)
def encoder(vocabulary: str):
    """The tiktoken encoding of a ranks file and its compiled pattern, loaded once per Python worker."""
    import base64

    import public_tokenizers
    import regex
    import tiktoken

    path = vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return enc, regex.compile(public_tokenizers.PATTERN)


def join_tokens(enc, left: list[int], right: list[int]) -> list[int]:
    """The ids of one piece from those of its two parts: a window around the cut grows until both ends stay."""
    k = 4
    while True:
        a, b = left[-k:], right[:k]
        window = enc._encode_single_piece(enc.decode_bytes(a) + enc.decode_bytes(b))  # noqa: SLF001
        if (k >= len(left) or window[0] == a[0]) and (k >= len(right) or window[-1] == b[-1]):
            return left[: len(left) - len(a)] + window + right[len(b) :]
        k *= 2


def leaf_state(enc, pattern, text: str) -> tuple[str, list[int], list[int]]:
    """A text's own ids and the ends of its pieces in characters."""
    return text, enc.encode_ordinary(text), [m.end() for m in pattern.finditer(text)]


def _tokens_before(enc, ids: list[int], n_bytes: int) -> int:
    """How many ids make up the first n_bytes."""
    n = at = 0
    while at < n_bytes:
        at += len(enc.decode_single_token_bytes(ids[n]))
        n += 1
    if at != n_bytes:
        raise AssertionError("a token crosses a piece boundary")
    return n


def _tokens_after(enc, ids: list[int], n_bytes: int) -> int:
    """How many ids make up the last n_bytes."""
    n = at = 0
    while at < n_bytes:
        n += 1
        at += len(enc.decode_single_token_bytes(ids[-n]))
    if at != n_bytes:
        raise AssertionError("a token crosses a piece boundary")
    return n


def join_states(enc, pattern, left: tuple, right: tuple) -> tuple[str, list[int], list[int]]:
    """The state of two texts put together from their states, without encoding more than the window around the cut."""
    (lt, lids, lends), (rt, rids, rends) = left, right
    if not lt or not rt:
        return right if not lt else left
    keep = len(lends)
    while keep and lends[keep - 1] > len(lt) - LOOK_AHEAD:
        keep -= 1
    start = lends[keep - 1] if keep else 0
    theirs, cut = set(rends) | {0}, len(lt) - start
    size = 256
    while True:
        whole = size >= len(rt)
        window = lt[start:] + rt[:size]
        ends = [m.end() for m in pattern.finditer(window)]
        if whole:
            meet = next((e for e in ends if e >= cut and e - cut in theirs), len(window))
        else:
            # the right part's boundaries near the window's end are its own, but the scan may have lacked what follows
            meet = next((e for e in ends if cut <= e <= len(window) - LOOK_AHEAD and e - cut in theirs), None)
        if meet is not None:
            break
        size *= 4
    fresh = [e for e in ends if e <= meet]
    tail = lt[start:]
    n_left = len(lids) - _tokens_after(enc, lids, len(tail.encode()))
    n_right = _tokens_before(enc, rids, len(rt[: meet - cut].encode()))
    old_left, old_right = lids[n_left:], rids[:n_right]
    own_last = lends[keep:] == [len(lt)] and (rends[:1] or [0])[0] == meet - cut
    if fresh == [meet] and own_last:
        middle = join_tokens(enc, old_left, old_right)
    else:
        middle, at = [], 0
        for e in fresh:
            middle += enc._encode_single_piece(window[at:e].encode())  # noqa: SLF001
            at = e
    ids = lids[:n_left] + middle + rids[n_right:]
    all_ends = lends[:keep] + [start + e for e in fresh] + [len(lt) + e for e in rends if e > meet - cut]
    return lt + rt, ids, all_ends


def encode_text(text: str, vocabulary: str = VOCABULARY, leaf: int = LEAF_CHARS) -> list[int]:
    """One text by the same tree of leaves and joins that the Spark plan runs."""
    enc, pattern = encoder(vocabulary)
    states = [leaf_state(enc, pattern, text[i : i + leaf]) for i in range(0, max(1, len(text)), leaf)]
    while len(states) > 1:
        pairs = [states[i : i + 2] for i in range(0, len(states), 2)]
        states = [join_states(enc, pattern, *p) if len(p) == 2 else p[0] for p in pairs]
    return states[0][1]


def encoded(docs: DataFrame, text: str = "text", out: str = "ids", vocabulary: str = VOCABULARY, leaf: int = LEAF_CHARS) -> DataFrame:
    """``docs`` without its text and with ``out``, an array of ids. Null and empty texts give an empty array.

    No special tokens: their strings are ordinary text. Repeated rows stay repeated; a column named like ``out`` is
    replaced. An empty table gives an empty one.
    """
    keep = [c for c in docs.columns if c not in (text, out)]
    rows = docs.select(*keep, F.col(text).alias("_text"))
    size = F.coalesce(F.char_length("_text"), F.lit(0))
    schema = rows.select(*keep, F.lit(None).cast("array<int>").alias(out)).schema

    def direct(batches):
        import numpy as np
        import pyarrow as pa

        enc, _ = encoder(vocabulary)
        for b in batches:
            per_row = [enc.encode_ordinary(t) if t else [] for t in b.column("_text").to_pylist()]
            offsets = np.zeros(len(per_row) + 1, np.int32)
            np.cumsum([len(x) for x in per_row], out=offsets[1:])
            flat = pa.array([i for x in per_row for i in x], pa.int32())
            ids = pa.ListArray.from_arrays(pa.array(offsets), flat)
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + [ids], names=[*keep, out])

    short = spread(rows.where(size <= leaf)).mapInArrow(direct, schema)
    longest = rows.agg(F.max(size)).first()[0] or 0
    if longest <= leaf:
        return short
    # equal texts are encoded once, whatever the other columns hold
    long = rows.where(size > leaf).withColumn("doc_key", F.concat(F.sha2("_text", 256), F.lit(":"), size.cast("string")))
    joined = _tree(long.select("doc_key", "_text").dropDuplicates(["doc_key"]), longest, vocabulary, leaf)
    return short.unionByName(long.join(joined, "doc_key").select(*keep, F.col("ids").alias(out)))


def _tree(long: DataFrame, longest: int, vocabulary: str, leaf: int) -> DataFrame:
    """``doc_key``, ``ids`` of texts that need several leaves; a level joins at most two parts in a task's group."""
    import pandas as pd

    def cut(frames):
        for f in frames:
            for key, text in zip(f["doc_key"], f["_text"], strict=True):
                for no, at in enumerate(range(0, len(text), leaf)):
                    yield pd.DataFrame({"doc_key": [key], "no": [no], "text": [text[at : at + leaf]]})

    def encode(frames):
        enc, pattern = encoder(vocabulary)
        for f in frames:
            s = [leaf_state(enc, pattern, t) for t in f["text"]]
            yield f.assign(ids=[x[1] for x in s], ends=[x[2] for x in s])[["doc_key", "no", "text", "ids", "ends"]]

    def join(f: pd.DataFrame) -> pd.DataFrame:
        enc, pattern = encoder(vocabulary)
        parts = [(r.text, list(map(int, r.ids)), list(map(int, r.ends))) for r in f.sort_values("no").itertuples()]
        text, ids, ends = parts[0] if len(parts) == 1 else join_states(enc, pattern, *parts)
        return pd.DataFrame({"doc_key": [f["doc_key"].iloc[0]], "no": [int(f["no"].iloc[0]) // 2], "text": [text], "ids": [ids], "ends": [ends]})

    leaves = long.mapInPandas(cut, "doc_key string, no long, text string").repartition("doc_key", "no")
    level, parts = leaves.mapInPandas(encode, _STATE), -(-longest // leaf)
    while parts > 1:
        level = level.groupBy("doc_key", F.floor(F.col("no") / 2).alias("half")).applyInPandas(join, _STATE)
        parts = -(-parts // 2)
    return level.select("doc_key", "ids")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents").select("doc_id", "text"))


def p8_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same ids with leaves so short that the longer documents of the tables need several."""
    return encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), leaf=1_024)


def p8_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, ids and ids per character by language as stored."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", "text")
    e = encoded(d)
    return e.groupBy("lang").agg(
        F.count("*").alias("n_docs"), F.sum(F.size("ids")).alias("n_ids"), F.sum("n_chars").alias("n_chars")
    )


QUERIES = {"p8_ids": p8_ids, "p8_tree": p8_tree, "p8_lengths": p8_lengths}
SQL: dict[str, str] = {}
