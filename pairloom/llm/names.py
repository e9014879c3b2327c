"""Queries p6: records of one person or organisation whose names are spelled in many ways.

Names become sets of tokens in Latin letters, without titles and legal forms. A symmetric-delete index over the distinct
tokens finds those a small edit apart; each token passes on to its more frequent neighbours, so writings of one token meet
at the one that most people use. Names meet in an equi-join on any token, however frequent, together with a second part:
the beginning of another token or an initial for persons, another token or the initials of all others for organisations.
Candidates are verified by an optimal assignment of their tokens, that
permits edits, short names, initials and abbreviations. Distinct names are joined, not records; a match of names links
records unless their birth dates differ, and where a name is only initials or a part, only if the dates agree.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm.addresses import close
from pairloom.llm.textforms import deletions, latin, phonetic
from pairloom.operators.entities import real_id, sides
from pairloom.session import Scratch, spread, table

PERSON, ORGANISATION = ["Person"], ["Company", "Organization", "LegalEntity"]
#: Tokens of this length or more may differ by an edit.
LEAST_EDITED = 4
#: Tokens of this length or more are no abbreviations or short names.
LONG = 6

# Titles, legal forms, words without weight, and short names that don't start like the long one.
TITLES = set("mr mrs ms miss mx dr prof professor sir dame lord lady sr sra srta mme mlle herr frau don dona jr hon rev".split())
LEGAL = [
    "limited liability company", "public limited company", "gesellschaft mit beschrankter haftung", "sociedad anonima",
    "joint stock company", "societe anonyme", "aktiengesellschaft", "limited", "ltd", "llc", "plc", "incorporated", "inc",
    "corporation", "corp", "company", "co", "gmbh", "sa", "jsc", "ao", "oao", "ooo", "zao", "pjsc", "ag", "sarl", "srl",
    "spa", "bv", "nv", "oy", "ab", "as", "kg", "lp", "llp", "pty", "pte",
]
WEIGHTLESS = {"the", "and", "of", "und", "et", "y", "i", "for"}
SHORT_NAMES = {
    "wilhelmina": "mina minnie", "elizabeth": "liz lizzie beth betty eliza", "richard": "dick rick rich", "michael": "mike mick",
    "robert": "bob rob bobby", "william": "bill will billy", "margaret": "peggy maggie meg greta", "edward": "ted ned eddie",
    "alexander": "alex sasha sandy", "katherine": "kate kathy katie", "joseph": "joe", "benjamin": "ben", "samuel": "sam",
    "daniel": "dan danny", "susannah": "sue susan suzy", "jose": "pepe", "ignacio": "nacho", "guadalupe": "lupe", "mikhail": "misha",
    "dmitri": "dima mitya", "konstantin": "kostya", "ivan": "vanya", "nikolai": "kolya", "friedrich": "fritz", "heinrich": "heinz",
    "giuseppe": "beppe", "andrew": "andy drew", "henry": "harry hal", "john": "jack johnny", "charles": "charlie chuck",
    "francisco": "paco", "anthony": "tony", "thomas": "tom", "james": "jim jimmy", "mohammed": "mo", "johannes": "hans",
}

_DOTTED = re.compile(r"\b(?:[a-z]\.\s?){2,}(?=\W|$)|\b(?:[a-z]\.){2,}[a-z]\b")
_WORDS = re.compile(r"[^\W_]+(?:'[^\W_]+)*")
_LEGAL = re.compile(r"\b(?:" + "|".join(LEGAL) + r")\b")


def name_key(value: str | None, person: bool) -> str:
    """A name's tokens, sorted, without what writings add or drop; empty if nothing is left."""
    if not value:
        return ""
    text = latin(value)
    if person:
        words = [w for w in _WORDS.findall(text) if w not in TITLES]
    else:
        text = re.sub(r"(?<=\w)'(?=\w)", "", text)
        if "." in text:
            text = _DOTTED.sub(lambda m: m.group().replace(".", "").replace(" ", "") + " ", text)
        bare = _LEGAL.sub(" ", " ".join(_WORDS.findall(text)))
        # misspelt legal forms, of which a long word is one edit away
        words = [w for w in bare.split() if w not in WEIGHTLESS and not _legal_like(w)]
    return " ".join(sorted(phonetic(" ".join(words).replace("'", "")).split(" ")))


_LONG_LEGAL = {w for form in LEGAL for w in form.split() if len(w) > 5 and w not in ("company",)} | {"company"}


@lru_cache(maxsize=200_000)
def _legal_like(word: str) -> bool:
    return len(word) > 5 and any(_edit(word, w) for w in _LONG_LEGAL)


def _edit(a: str, b: str) -> bool:
    """Equal, or one letter missing, added, changed or swapped with its neighbour."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


_SHORT = {frozenset((phonetic(k), phonetic(s))) for k, v in SHORT_NAMES.items() for s in v.split()}
_LONG_OF = {s: sorted(k for k in map(phonetic, SHORT_NAMES) if frozenset((k, s)) in _SHORT) for v in SHORT_NAMES.values() for s in phonetic(v).split()}


@lru_cache(maxsize=500_000)
def token_score(a: str, b: str, person: bool) -> float:
    """How well two tokens match: 3 equal, 2 an edit, a short name or an abbreviation, 1 an initial, 0 not at all."""
    if a == b:
        return 3 if len(a) > 1 else 1
    if len(a) > len(b):
        a, b = b, a
    if len(a) >= LEAST_EDITED - 1 and len(b) >= LEAST_EDITED and _edit(a, b):
        return 2
    if len(a) == 1:
        return 1 if b[0] == a else 0
    if person:
        if frozenset((a, b)) in _SHORT:
            return 2
        same = 0
        while same < len(a) and a[same] == b[same]:
            same += 1
        return 2 if same >= 3 and len(a) <= same + 2 and len(a) < 7 and a[-1] in "ioae" and len(b) > len(a) - 1 else 0
    if a[0] == b[0] and len(a) >= 2 and len(b) >= len(a) + 2:
        at = 0
        for c in a:
            at = b.find(c, at) + 1
            if not at:
                return 0
        return 2
    return 0


def best_assignment(value: list[list[float]]) -> list[int]:
    """The column of each row, all different, with the largest sum; no more rows than columns. Shortest augmenting paths."""
    n, m = len(value), len(value[0]) if value else 0
    if n == 0:
        return []
    if n == 1:
        return [max(range(m), key=value[0].__getitem__)]
    if n <= 3 and m <= 4:
        best = max(permutations(range(m), n), key=lambda p: sum(value[i][j] for i, j in enumerate(p)))
        return list(best)
    u, v, row_of, way = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        row_of[0], j0 = i, 0
        least, used = [float("inf")] * (m + 1), [False] * (m + 1)
        while True:
            used[j0] = True
            i0, delta, j1 = row_of[j0], float("inf"), 0
            for j in range(1, m + 1):
                if not used[j]:
                    cost = -value[i0 - 1][j - 1] - u[i0] - v[j]
                    if cost < least[j]:
                        least[j], way[j] = cost, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(m + 1):
                if used[j]:
                    u[row_of[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
            if not row_of[j0]:
                break
        while j0:
            row_of[j0] = row_of[way[j0]]
            j0 = way[j0]
    out = [0] * n
    for j in range(1, m + 1):
        if row_of[j]:
            out[row_of[j] - 1] = j - 1
    return out


def match_strength(one: str, other: str, person: bool) -> int:
    """2: the names match in full; 1: as far as initials or a missing part go; 0: they don't. Empty names never match."""
    a, b = one.split(), other.split()
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0
    # tokens that are equal are taken first, the few others are assigned in the best way
    rest_b, rest_a, scores = list(b), [], []
    for t in a:
        if len(t) > 1 and t in rest_b:
            rest_b.remove(t)
            scores.append(3)
        else:
            rest_a.append(t)
    scored = [[token_score(t, u, person) for u in rest_b] for t in rest_a]
    for t, row in zip(rest_a, scored, strict=True):
        if not any(row) and (len(t) > 1 or not person):
            return 0
    # a match counts before its quality, and that before taking a whole token rather than an initial
    value = [[100 * (x > 0) + 10 * x + (len(u) > 1) for x, u in zip(row, rest_b, strict=True)] for row in scored]
    chosen = best_assignment(value)
    s = [row[j] for row, j in zip(scored, chosen, strict=True)]
    left = [t for j, t in enumerate(rest_b) if j not in chosen]
    if person:
        # initials that conflict are middle initials, which writers leave out or mistake
        s = [x for t, x in zip(rest_a, s, strict=True) if x or len(t) > 1]
    scores += s
    if not all(scores) or not scores:
        return 0
    full = sum(x >= 2 for x in scores)
    if sum(x == 2 for x in scores) > 2 or max(scores) < 2:
        return 0
    extra = sum(len(t) > 1 for t in left)
    if person:
        if full >= 2:
            return 2 if extra == 0 else (1 if extra == 1 else 0)
        return 1 if len(scores) + len(left) >= 2 and extra == 0 and full == 1 and len(scores) >= 2 else 0
    if extra == 0:
        return 2 if len(scores) >= 2 or (len(b) == 1 and scores == [3]) else 0
    return 1 if extra == 1 and full >= 2 else 0


def named_records(pairs: DataFrame) -> DataFrame:
    """``id``, ``person``, ``value``, distinct, of persons and organisations: caption, name and alias of all versions."""
    p = F.col("e.properties")
    some = lambda k: F.coalesce(F.try_element_at(p, F.lit(k)), F.array().cast("array<string>"))
    values = F.array_distinct(F.concat(F.array("e.caption"), some("name"), some("alias")))
    s = sides(pairs).where(F.col("e.schema").isin(PERSON + ORGANISATION))
    s = s.select(real_id(F.col("e.id")).alias("id"), F.col("e.schema").isin(PERSON).alias("person"), F.explode(values).alias("value"))
    return s.where("id is not null and trim(value) <> ''").distinct()


def birth_dates(pairs: DataFrame) -> DataFrame:
    """``id``, ``dates``: the distinct birth dates of each id as far as they start with a year, cut to a day."""
    s = sides(pairs).where(F.col("e.schema").isin(PERSON))
    value = F.explode(F.try_element_at("e.properties", F.lit("birthDate"))).alias("d")
    s = s.select(real_id(F.col("e.id")).alias("id"), value).withColumn("d", F.substring(F.trim("d"), 1, 10))
    return s.where("id is not null and d rlike '^[0-9]{4}'").groupBy("id").agg(F.collect_set("d").alias("dates"))


def keyed(values: DataFrame) -> DataFrame:
    """``id``, ``person``, ``name``: distinct name keys of each record."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            keys = [name_key(v, p) for v, p in zip(b.column("value").to_pylist(), b.column("person").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("person"), pa.array(keys, pa.string())], names=["id", "person", "name"])

    return spread(values.select("id", "person", "value")).mapInArrow(run, "id string, person boolean, name string").where("name <> ''").distinct()


def token_index(names: DataFrame, scratch: Scratch) -> DataFrame:
    """``token``, ``keys``: the tokens that each token meets others at, itself among them.

    Neighbours share a form with at most one letter deleted and are an edit apart. A token passes on to those that are
    more frequent, so that two tokens that are an edit apart always share a key. A short name meets its long ones, too.
    """
    counted = names.select(F.explode(F.split("name", " ")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    counted = scratch.save(counted, "tokens")

    def forms(batches):
        import pyarrow as pa
        import xxhash

        for b in batches:
            rows = [
                (xxhash.xxh3_64_intdigest(v) - 2**63, t, n)
                for t, n in zip(b.column("token").to_pylist(), b.column("n").to_pylist(), strict=True)
                for v in deletions(t)
            ]
            cols = list(zip(*rows, strict=True)) if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64())], names=["form", "token", "n"])

    long = spread(counted.where(F.length("token") >= LEAST_EDITED - 1))
    f = scratch.save(long.mapInArrow(forms, "form long, token string, n long"), "forms")
    other = f.select("form", F.col("token").alias("near"), F.col("n").alias("m"))
    meet = f.join(other, "form").where("token <> near and (m > n or (m = n and near < token))")
    meet = meet.where((F.greatest(F.length("token"), F.length("near")) >= LEAST_EDITED) & close(F.col("token"), F.col("near"))).select("token", "near").distinct()
    near = meet.groupBy("token").agg(F.collect_list("near").alias("near"))
    none = F.array().cast("array<string>")
    long_of = F.create_map(*[x for s, ks in _LONG_OF.items() for x in (F.lit(s), F.array(*map(F.lit, ks)))])
    index = counted.join(near, "token", "left").select(
        "token", "n",
        F.array_distinct(F.concat(F.array("token"), F.coalesce("near", none), F.coalesce(F.try_element_at(long_of, "token"), none))).alias("keys"),
    )
    index = scratch.save(index, "index")
    scratch.drop(f)
    return index


def second_parts(side: str) -> Column:
    """What a token adds to another token's key, so that only names meet that may match in both.

    Long tokens meet by their beginnings; a short one (of persons an initial, of organisations what may be an
    abbreviation) and another meet by their initials. ``side`` is ``one`` or ``any``: one name's parts are joined to any
    part of the other.
    """
    starts = lambda n, mark: F.transform("keys", lambda k: F.concat(F.lit(mark), F.substring(k, 1, n)))
    marked = lambda marks: F.concat(*[starts(3 if m == "p" else 1, m) for m in marks])
    # p two long tokens, w a short one that meets a long one, i a long one that meets a short one, s two short ones
    short, long = ("ws", "pi") if side == "one" else ("is", "pw")
    is_short = F.length("token") < F.when(F.col("person"), 2).otherwise(LONG)
    return F.array_distinct(F.transform(F.when(is_short, marked(short)).otherwise(marked(long)), lambda x: F.hash(x)))


def candidate_names(names: DataFrame, scratch: Scratch) -> DataFrame:
    """``a``, ``b``, ``a < b``: the numbers of names (``nid``, ``person``, ``name``) that may match.

    If names match, all whole tokens of the one with fewer tokens do. So one name gives the key of its rarest token
    together with a part of the next rare one, the other those of all its tokens: how many names a frequent word is in
    doesn't matter, only in how many it is the rarest. A short token may be an abbreviation, which has no key in common
    with the whole: it passes the part of the rarest on to the next. Only where all other tokens are initials is each of
    them a second part.
    """
    index = token_index(names, scratch)
    tokens = names.select("nid", "person", F.explode(F.split("name", " ")).alias("token")).join(index, "token")
    traits = [F.exists("keys", lambda k: F.length(k) >= 3).alias("able"), (F.length("token") >= LONG).alias("long"), (F.length("token") > 1).alias("whole")]
    hashed = F.transform("keys", lambda k: F.xxhash64(k)).alias("keys")
    tokens = tokens.select(
        "nid", "person", F.struct("n", F.xxhash64("token").alias("h"), hashed, *traits, second_parts("one").alias("one"), second_parts("any").alias("any")).alias("t")
    )
    known = tokens.groupBy("nid", "person").agg(F.array_sort(F.collect_list("t")).alias("ts")).where(F.size("ts") > 1)
    each = known.select("nid", "person", "ts", F.posexplode("ts").alias("at", "t")).where("t.able")
    others = F.filter("ts", lambda o, i: i != F.col("at"))
    parts = lambda c, o: F.array_distinct(F.flatten(F.transform(o, lambda x: x[c])))
    first = ~F.exists(F.slice("ts", F.lit(1), F.col("at")), lambda x: x["able"] & x["long"])
    whole = F.filter("others", lambda x: x["whole"])
    each = each.withColumn("others", others)
    each = each.select(
        "nid", "person", "t.keys", parts("any", F.col("others")).alias("any"),
        F.when(first & (F.size(whole) > 0), F.get(whole, F.lit(0))["one"]).when(first, parts("one", F.col("others"))).alias("one"),
    )

    def keys(side: str) -> DataFrame:
        k = each.select("nid", "person", F.explode("keys").alias("k"), side)
        k = k.select("nid", "person", "k", F.explode(side).alias("second"))
        return k.select("nid", F.xxhash64("person", "k", "second").alias("key"))

    each = scratch.save(each, "each")
    met = keys("one").withColumnRenamed("nid", "a").join(keys("any").withColumnRenamed("nid", "b"), "key").where("a <> b")
    # made distinct where the join with the names wants them
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).repartition("a").distinct()


def matching_names(names: DataFrame, scratch: Scratch) -> DataFrame:
    """``a``, ``b``, ``person``, ``strength``, ``wa``, ``wb``: pairs of distinct names that match, ``a < b``.

    ``names`` has ``nid``, ``person``, ``name``, ``wholes``; ``wa`` and ``wb`` are how many tokens of each are no initials.
    """
    met = candidate_names(names, scratch)
    side = lambda x: names.select(F.col("nid").alias(x), F.col("person").alias(f"p_{x}"), F.col("name").alias(f"n_{x}"), F.col("wholes").alias(f"w{x}"))
    both = met.join(side("a"), "a").join(side("b"), "b").where("p_a = p_b")

    def verify(batches):
        import pyarrow as pa

        for batch in batches:
            s = [match_strength(a, b, p) for p, a, b in zip(*[batch.column(c).to_pylist() for c in ("p_a", "n_a", "n_b")], strict=True)]
            kept = [batch.column(c) for c in ("a", "b", "p_a", "wa", "wb")]
            out = pa.RecordBatch.from_arrays([*kept, pa.array(s, pa.int32())], names=["a", "b", "person", "wa", "wb", "strength"])
            yield out.filter(pa.array([x > 0 for x in s], pa.bool_()))

    return both.mapInArrow(verify, "a long, b long, person boolean, wa int, wb int, strength int")


def agree(a, b):
    """Whether two sets of birth dates hold a compatible pair: equal, or one a year (or month) that the other has."""
    return F.exists(a, lambda x: F.exists(b, lambda y: x.startswith(y) | y.startswith(x) | _open_day(x, y) | _open_day(y, x)))


def _open_day(x, y):
    """A first of January stands for its year."""
    return x.endswith("-01-01") & (F.substring(x, 1, 4) == F.substring(y, 1, 4)) & (F.length(y) == 4)


def same_names(values: DataFrame, dates: DataFrame) -> DataFrame:
    """``id_a``, ``id_b``, smaller first: records whose names match and whose birth dates don't say otherwise.

    ``values`` as of ``named_records``, ``dates`` as of ``birth_dates``. Records with dates meet by name and year, so
    namesakes of other years are never paired; those without a date meet everyone of the name, if the name is full or all
    known birth years of those it may stand for are one.
    """
    scratch = Scratch(values.sparkSession, "names")
    records, salt = scratch.save(keyed(values), "records"), 0
    wholes = F.size(F.filter(F.split("name", " "), lambda t: F.length(t) > 1)).alias("wholes")
    distinct = scratch.save(records.select("person", "name", wholes).distinct(), "distinct")
    number = lambda: F.xxhash64(F.lit(salt), "person", "name").alias("nid")
    # names are numbered by hash; for n names n^2 / 2^65 clashes are expected, and another hash is taken where there is one
    while not distinct.groupBy(number()).count().where("count > 1").isEmpty():
        salt += 1
    names, records = distinct.select(number(), "*"), records.select("id", number())
    matched = matching_names(names, scratch)
    full = F.col("wholes") >= F.when(F.col("person"), 2).otherwise(1)
    own = names.select(F.col("nid").alias("a"), F.col("nid").alias("b"), "person", F.col("wholes").alias("wa"), F.col("wholes").alias("wb"), F.when(full, 2).otherwise(1).alias("strength"))
    matched = scratch.save(matched.unionByName(own), "matched")
    links = matched.unionByName(matched.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "person", F.col("wb").alias("wa"), F.col("wa").alias("wb"), "strength"))
    held = scratch.save(records.join(dates, "id", "left"), "held")
    year = F.explode_outer(F.array_distinct(F.transform("dates", lambda d: F.substring(d, 1, 4))))
    side = lambda x: held.select(F.col("nid").alias(x), F.col("id").alias(f"id_{x}"), F.col("dates").alias(f"d_{x}"))
    dated = lambda x: held.where("dates is not null").select(F.col("nid").alias(x), F.col("id").alias(f"id_{x}"), F.col("dates").alias(f"d_{x}"), year.alias("year"))
    same_year = links.select("a", "b").join(dated("a"), "a").join(dated("b"), ["b", "year"])
    same_year = same_year.where((F.col("id_a") < F.col("id_b")) & agree(F.col("d_a"), F.col("d_b"))).select("id_a", "id_b")
    # a name of initials stands for one person where all who may be meant were born in one year, as far as is known
    partial = links.where("person and strength = 1 and wa < wb").select("a", "b")
    years = partial.join(dated("b"), "b").groupBy("a").agg(F.count_distinct("year").alias("n_years"))
    weak = partial.join(years.where("n_years > 1").select("a"), "a", "left_anti")
    weak = weak.unionByName(weak.select(F.col("b").alias("a"), F.col("a").alias("b")))
    undated = links.where("strength = 2").select("a", "b").unionByName(weak)
    undated = undated.join(side("a").where("d_a is null"), "a").join(side("b"), "b")
    undated = undated.where("id_a <> id_b").select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))
    return same_year.unionByName(undated).distinct()


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "pairs")
    return same_names(named_records(pairs), birth_dates(pairs))


def p6_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct name key and how many records hold it."""
    k = keyed(named_records(table(spark, sf_dir, "pairs")))
    return k.groupBy("person", "name").agg(F.count_distinct("id").alias("n_ids"))


QUERIES = {"p6_found": p6_found, "p6_names": p6_names}
SQL: dict[str, str] = {}
