"""Connected components by randomised contraction.

In each round every vertex takes the smallest hash among itself and its neighbours as its new name, edges are renamed,
made distinct and loops removed, until no edge is left; then the rounds' renamings are composed backwards. The hash of a
round is a fresh bijection of 64-bit names, so a name never needs a tie-break and the minimum is one long aggregate that
combines on the map side: a hub that touches a third of all edges costs one row per task. The number of vertices with
edges falls by a constant factor per round in expectation, whatever the shape of the graph, so chains take O(log n)
rounds. Joins on names may meet a hub; the adaptive skew join splits it, as every name has one row on the other side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.session import Scratch

#: Ids that share a 64-bit hash get other names one by one; for n ids about n^2 / 2^65 pairs of them are expected.
MAX_CLASHES = 10_000


def bijection(x: Column, seed: int) -> Column:
    """xxhash64 of one 64-bit value under a fixed seed: every step of it can be undone, so no two values meet."""
    return F.xxhash64(F.lit(seed), x)


def _names(ids: DataFrame, hashed) -> tuple[DataFrame, dict[str, int]]:
    """``(key, id)`` with one row per distinct id, and the ids whose key isn't their hash."""
    by_key = ids.groupBy(hashed(F.col("id")).alias("key")).agg(F.min("id").alias("id"), F.max("id").alias("other"))
    return by_key


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", hashed=None, max_rounds: int = 200) -> DataFrame:
    """``id``, ``group_id``: each id that an edge links to another id, with the smallest id of its component.

    Edges with a null end and loops link nothing; repeated and reversed edges count once; other columns are ignored.
    No edges give no rows. Ids compare by code point. ``hashed`` maps an id column to 64-bit keys (tests pass a bad one
    to meet clashes).
    """
    hashed = hashed or F.xxhash64
    spark, scratch = edges.sparkSession, Scratch(edges.sparkSession, "components")
    raw = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    ends = raw.select(F.explode(F.array("a", "b")).alias("id"))
    names = scratch.save(_names(ends, hashed), "names")
    moved = _clashes(ends, names, hashed)
    key = _key_of(hashed, moved)
    if moved:
        names = names.where("id = other").select("key", "id").unionByName(
            spark.createDataFrame([(k, i) for i, k in moved.items()], "key long, id string")
        )
    names = names.select("key", "id")
    u, v = key(F.col("a")), key(F.col("b"))
    live = scratch.save(raw.select(F.least(u, v).alias("u"), F.greatest(u, v).alias("v")).distinct(), "edges")
    rounds = []
    while not live.isEmpty():
        if len(rounds) >= max_rounds:
            raise RuntimeError(f"no end after {max_rounds} rounds")
        seed = len(rounds) + 1
        both = live.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e"))
        near = both.select("e.u", bijection(F.col("e.v"), seed).alias("h")).groupBy("u").agg(F.min("h").alias("h"))
        step = scratch.save(near.select(F.col("u").alias("x"), F.least("h", bijection(F.col("u"), seed)).alias("y")), "step")
        rounds.append(step)
        left = step.select(F.col("x").alias("u"), F.col("y").alias("yu"))
        right = step.select(F.col("x").alias("v"), F.col("y").alias("yv"))
        moved_edges = live.join(left, "u").select("v", "yu").join(right, "v").where("yu <> yv")
        after = moved_edges.select(F.least("yu", "yv").alias("u"), F.greatest("yu", "yv").alias("v")).distinct()
        after = scratch.save(after, "edges")
        scratch.drop(live)
        live = after
    label = _expand(rounds, scratch)
    if label is None:
        return names.select("id", F.col("id").alias("group_id")).where(F.lit(False))
    named = scratch.save(names.join(label, names.key == label.x).select("id", "label"), "labelled")
    least = named.groupBy("label").agg(F.min("id").alias("group_id"))
    return named.join(least, "label").select("id", "group_id")


def _expand(rounds: list[DataFrame], scratch: Scratch) -> DataFrame | None:
    """``x``, ``label``: the rounds' renamings composed. A name that a later round doesn't know passes its bijections."""
    label = None
    for i in range(len(rounds) - 1, -1, -1):
        step = rounds[i]
        if label is None:
            label = step.select("x", F.col("y").alias("label"))
            continue
        unmoved = F.col("y")
        for later in range(i + 1, len(rounds)):
            unmoved = bijection(unmoved, later + 1)
        known = label.select(F.col("x").alias("y"), "label")
        label = step.join(known, "y", "left").select("x", F.coalesce("label", unmoved).alias("label"))
    return label


def _clashes(ends: DataFrame, names: DataFrame, hashed) -> dict[str, int]:
    """Other keys for all ids but the smallest that share a hash. There are next to none, which is checked."""
    shared = names.where("id <> other").select("key")
    if shared.isEmpty():
        return {}
    rows = (
        ends.withColumn("key", hashed(F.col("id"))).join(F.broadcast(shared), "key", "left_semi").select("id").distinct()
    ).limit(MAX_CLASHES + 1).collect()
    if len(rows) > MAX_CLASHES:
        raise RuntimeError("the hash of the ids is no good: too many ids share one")
    ids, out, salt = sorted(r.id for r in rows), {}, 0
    spark = ends.sparkSession
    while len(out) < len(ids):
        salt += 1
        todo = [i for i in ids if i not in out]
        tried = spark.createDataFrame([(i,) for i in todo], "id string").select("id", F.xxhash64(F.lit(salt), "id").alias("key"))
        free = tried.join(names.select("key"), "key", "left_anti").collect()
        for r in sorted(free, key=lambda r: r.id):
            if r.key not in out.values():
                out[r.id] = r.key
    return out


def _key_of(hashed, moved: dict[str, int]):
    if not moved:
        return lambda c: hashed(c)
    pairs = F.create_map(*[F.lit(x) for item in moved.items() for x in item])
    return lambda c: F.coalesce(F.try_element_at(pairs, c), hashed(c))
