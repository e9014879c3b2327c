"""Queries p2: address records that denote the same building, however written.

Each address is expanded into all plausible normalised forms of street name, street kind, house number, town and
postcode. Each form gives hashes of component combinations, also with one letter of the street and the town left out;
forms that share a hash meet in an equi-join, and those whose house numbers, street kinds, towns or postcodes conflict
are rejected. A town that a form lacks is taken from the postcode, as the corpus writes it most often. The unit in the
building plays no part. Distinct forms are joined, not records; ids come back at the end.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm.textforms import deletions, latin, phonetic
from pairloom.operators.entities import real_id, sides
from pairloom.session import Scratch, spread, table

# Words for kinds of streets, by where the name stands, and for countries, units and house numbers.
NAME_BEFORE = {
    "street": ["street", "st", "str"], "road": ["road", "rd"], "lane": ["lane", "la", "ln"], "drive": ["drive", "dr", "drv"],
    "square": ["square", "sq"], "court": ["court", "ct", "crt"],
}
NAME_AFTER = {
    "rue": ["rue", "r"], "boulevard": ["boulevard", "blvd", "bd", "bld"], "calle": ["calle", "c/", "cl", "c"],
    "plaza": ["plaza", "pza", "pl"],
}
NAME_EITHER = {
    "avenue": ["avenue", "ave", "av", "avenida", "avda"], "street": ["ulitsa", "ul", "ulica", "str"],
    "pereulok": ["pereulok", "per"], "prospekt": ["prospekt", "prosp", "pr", "pr-t", "prkt"],
}
SUFFIXES = {"street": ["strasse", "str"], "weg": ["weg"], "platz": ["platz", "plz", "pl"], "allee": ["allee"]}
COUNTRIES = [
    "united states of america", "united states", "united kingdom", "great britain", "russian federation", "germany",
    "deutschland", "spain", "espana", "france", "russia", "rossija", "rossiya", "u.s.a.", "u.s.", "u.k.", "usa", "us",
    "uk", "gb", "de", "es", "fr", "ru",
]
UNITS = ["flat", "apartment", "apt", "unit", "office", "suite", "room", "kv", "ofis", "piso", "wohnung"]
HOUSES = ["house", "haus", "dom", "d", "no", "nr", "num", "nº", "n°", "n", "№"]
TOWNS = ["g", "gorod"]
#: Words that are part of the street's name where they stand before it.
BEFORE_NAMES = ["north", "south", "east", "west", "upper", "lower", "old", "new", "great", "little", "saint", "san", "santa"]

_KINDS = {w: (k, where) for where, t in (("b", NAME_BEFORE), ("a", NAME_AFTER), ("e", NAME_EITHER)) for k, ws in t.items() for w in ws}
_SUFFIX = [(s, k) for k, ss in SUFFIXES.items() for s in sorted(ss, key=len, reverse=True)]
_COUNTRY = re.compile(r"(?<![\w.])(?:" + "|".join(re.escape(c) for c in COUNTRIES) + r")(?![\w-]|\.\w)\.?")
_UNIT = re.compile(r"(?:(?<!\w)(?:" + "|".join(UNITS) + r")\b\.?|#)\s*\d+[a-z]?\b")
_PREFIXED = re.compile(r"(?<!\w)(?:usa|us|uk|gb|ru|es|de|fr)\s*-\s*(?=\d)")
_HOUSE = re.compile(r"(?<!\w)(?:" + "|".join(HOUSES) + r")\.?\s*(\d{1,5})(?:\s*-?\s*([a-d]))?(?!\w)")
_NUMBER = re.compile(r"(?<!\w)(\d{1,5})(?:\s?-?\s?([a-d]))?(?!\w)")
_SIX = re.compile(r"(?<![\w-])(?:(\d{2})-(\d{4})|(\d{6}))(?![\w-])")
_SHORT_CODE = re.compile(r"(?<![\w-])\d{4,5}(?![\w-])")
_LETTER_CODE = re.compile(r"(?<!\w)([A-Z]{1,2}\d[A-Z\d]?) (\d[A-Z]{2})(?!\w)")
_THREES = re.compile(r"(?<![\w-])\d{3}(?: \d{3})+(?![\w-])")


def _clean(text: str) -> str:
    text = re.sub(r"([^\W\d_])№|№", r"\1 № ", text)
    text = re.sub(r"(?<=[a-zа-яё])(?=[A-ZА-ЯЁ])", " ", text)  # a separator got lost between two words
    text = latin(re.sub(r"[\n\r\t]+", " ; ", text))
    text = re.sub(r"(?<=\d)(?=[^\W\d_]{2})|(?<=[a-z])(?=\d)", " ", text)
    text = re.sub(r"(?<!\d)(\d{1,3})(\d{6})(?!\d)", r"\1 \2", text)
    return re.sub(r"\s+", " ", text).strip()


def address_forms(text: str | None) -> list[tuple[str, str, str, str, str]]:
    """All plausible ``(street, kind, house, town, postcode)`` of one address; parts that are missing are empty.

    Nothing comes of null, blank or unreadable text, nor of one without a street or a house number. Where no word names the
    kind of street, the words beside the house number are the street, without a kind.
    """
    if not text or not text.strip():
        return []
    lettered = _LETTER_CODE.search(text)
    if lettered:
        text = text[: lettered.start()] + " , " + text[lettered.end() :]
    rest = _COUNTRY.sub(" ; ", _PREFIXED.sub("", _clean(text)))
    without = _UNIT.sub(" ", rest)
    if re.search(r"\d", _SIX.sub(" ", without)) is None:
        without = rest.replace("#", " ")  # the only number is the house's
    rest = without
    codes: list[tuple[str, str]] = []
    six = _SIX.search(rest)
    if six:
        codes = [("".join(filter(None, six.groups())), rest[: six.start()] + " ; " + rest[six.end() :])]
    else:
        for m in _THREES.finditer(rest):
            threes = m.group().split(" ")
            for i in range(len(threes) - 1):
                left, right = " ".join(threes[:i]), " ".join(threes[i + 2 :])
                codes.append((threes[i] + threes[i + 1], f"{rest[: m.start()]} {left} ; {right} {rest[m.end() :]}"))
    if not codes:
        # a number of four or five digits is a postcode where another number can be the house's
        for m in _SHORT_CODE.finditer(rest):
            body = f"{rest[: m.start()]} ; {rest[m.end() :]}"
            if _NUMBER.search(body):
                codes.append((m.group(), body))
    if lettered:
        codes = [("".join(lettered.groups()).lower(), body) for _, body in codes or [("", rest)]]
    forms = set()
    for code, body in codes or [("", rest)]:
        for house, words in _houses(body):
            for street, kind, town in _streets(words):
                forms.add((street, kind, house, town, code))
    if not forms and codes:  # the six digits may be a house and something else
        for house, words in _houses(rest):
            for street, kind, town in _streets(words):
                forms.add((street, kind, house, town, ""))
    if not forms:  # no word says what kind of street it is: the street is what stands with the house number
        for code, body in codes or [("", rest)]:
            for house, words in _houses(body):
                forms |= {(street, "", house, town, code) for street, town in _unnamed(words)}
    return sorted(forms)


def _segments(body: str) -> list[list[str]]:
    """The words of each part of an address, with the house number's place."""
    segments = []
    for part in re.split(r"[,;]|(?<!c)/| - ", body):
        words = [w.strip(".'\"()-") if w not in ("c/", "\0") else w for w in part.split()]
        words = [w for w in words if w and not w.isdigit() and w not in TOWNS]
        if words:
            segments.append(words)
    return segments


def _unnamed(body: str):
    """The words that stand with the house number as a street, those of all other parts as a town."""
    segments = _segments(body)
    long = lambda ws: phonetic("".join(w for w in ws if len(w) > 2 and w not in UNITS and w not in HOUSES))
    for s, words in enumerate(segments):
        if "\0" in words and long(words):
            yield long(words), long([w for t, ws in enumerate(segments) if t != s for w in ws])


def _houses(body: str):
    """Each number that can be the house's, and the words without it."""
    m = _HOUSE.search(body)
    if m:
        yield m[1].lstrip("0") + (m[2] or ""), body[: m.start()] + " \0 " + body[m.end() :]
        return
    for m in _NUMBER.finditer(body):
        yield m[1].lstrip("0") + (m[2] or ""), body[: m.start()] + " \0 " + body[m.end() :]


def _streets(body: str):
    """Each reading of the words as a street and a town."""
    segments = _segments(body)
    for s, words in enumerate(segments):
        for i, w in enumerate(words):
            for name, kind, used in _readings(words, i, w):
                towns = [x for t, ws in enumerate(segments) for j, x in enumerate(ws) if x != "\0" and (t != s or j not in used)]
                towns = [x for x in towns if len(x) > 2 and x not in _KINDS and x not in UNITS and x not in HOUSES]
                yield phonetic(name), kind, phonetic("".join(towns))


def _readings(words: list[str], i: int, w: str):
    if w in _KINDS:
        kind, where = _KINDS[w]
        ok = lambda j: 0 <= j < len(words) and words[j] != "\0" and len(words[j]) > 2 and words[j] not in _KINDS
        before, after = ok(i - 1), ok(i + 1)
        if before and (where in "be" or not after):
            more = i >= 2 and words[i - 2] in BEFORE_NAMES
            yield (words[i - 2] if more else "") + words[i - 1], kind, {i - 2 if more else i, i - 1, i}
        if after and (where in "ae" or not before):
            more = i + 2 < len(words) and words[i + 1] in BEFORE_NAMES and words[i + 2] != "\0"
            yield words[i + 1] + (words[i + 2] if more else ""), kind, {i, i + 1, i + 2 if more else i}
        return
    for suffix, kind in _SUFFIX:
        if w.endswith(suffix) and len(w) > len(suffix) + 2:
            yield w[: -len(suffix)], kind, {i}
            return
    if w in ("strasse", "weg", "platz", "allee") and i and words[i - 1] != "\0":
        yield words[i - 1], {"strasse": "street"}.get(w, w), {i - 1, i}


def form_keys(street: str, house: str, town: str, code: str) -> list[str]:
    """The component combinations by which forms meet; a letter may be missing in street and town, or in either."""
    keys, streets = set(), deletions(street)
    if code:
        keys |= {f"p|{v}|{house}|{code}" for v in streets}
    if town:
        keys |= {f"t|{v}|{house}|{w}" for w in deletions(town) for v in streets}
    if not town and not code:
        keys.add(f"n|{street}|{house}")
    return sorted(keys)


def address_values(pairs: DataFrame) -> DataFrame:
    """``id``, ``address``: distinct non-blank addresses of person and organisation records, over all their versions."""
    s = sides(pairs).where(F.col("e.schema").isin("Person", "Company", "Organization", "LegalEntity"))
    value = F.explode(F.try_element_at("e.properties", F.lit("address")))
    return s.select(real_id(F.col("e.id")).alias("id"), value.alias("address")).where("id is not null and trim(address) <> ''").distinct()


_FORM = "street string, kind string, house string, town string, code string"


def parsed(addresses: DataFrame) -> DataFrame:
    """``address`` and its forms, one row each."""

    def run(frames):
        import pandas as pd

        for f in frames:
            rows = [(a, *form) for a in f["address"] for form in address_forms(a)]
            yield pd.DataFrame(rows, columns=["address", "street", "kind", "house", "town", "code"])

    return spread(addresses.select("address")).mapInPandas(run, f"address string, {_FORM}")


def swapped(a, b):
    """Whether two columns hold the same letters in another order: two letters changed places."""
    letters = lambda c: F.array_sort(F.split(c, ""))
    return (F.length(a) == F.length(b)) & (letters(a) == letters(b))


def close(a, b):
    """At most one letter missing, added, changed or swapped with its neighbour."""
    d = F.levenshtein(a, b, 2)
    return (a == b) | d.between(0, 1) | ((d == 2) & swapped(a, b))


def same_building(values: DataFrame) -> DataFrame:
    """``id_a``, ``id_b``, smaller first: ids that each hold an address of the same building.

    ``values`` has ``id`` and ``address``. Addresses that lack a street, a house number, or both town and postcode match
    only those that lack the same. Ids with an equal address match, too, if it can be read as one.
    """
    scratch = Scratch(values.sparkSession, "addresses")
    read = scratch.save(parsed(values.select("address").distinct()), "parsed")
    known = read.where("town <> '' and code <> ''").groupBy("code", "town").agg(F.count(F.lit(1)).alias("n"))
    towns = known.groupBy("code").agg(F.max_by("town", F.struct("n", "town")).alias("usual"))
    filled = read.join(towns, "code", "left").withColumn(
        "town", F.when((F.col("town") == "") | close(F.col("town"), F.col("usual")), F.coalesce("usual", "town")).otherwise(F.col("town"))
    )
    part = ["street", "kind", "house", "town"]
    name = F.xxhash64(*part), F.xxhash64(F.lit(1), *part)
    named = scratch.save(filled.select("address", *part, "code", name[0].alias("f1"), name[1].alias("f2")), "forms")
    codes = F.collect_set(F.when(F.col("code") != "", F.col("code")))
    distinct = scratch.save(named.groupBy("f1", "f2", *part).agg(codes.alias("codes")), "distinct")
    keys = scratch.save(spread(distinct).mapInPandas(_keys, "f1 long, f2 long, key long"), "keys")
    left = keys.select("key", F.col("f1").alias("a1"), F.col("f2").alias("a2"))
    right = keys.select("key", F.col("f1").alias("b1"), F.col("f2").alias("b2"))
    met = left.join(right, "key").where("a1 < b1 or (a1 = b1 and a2 < b2)").select("a1", "a2", "b1", "b2").distinct()
    side = lambda x: distinct.select(
        F.col("f1").alias(f"{x}1"), F.col("f2").alias(f"{x}2"), *[F.col(c).alias(f"{x}_{c}") for c in [*part, "codes"]]
    )
    c = met.join(side("a"), ["a1", "a2"]).join(side("b"), ["b1", "b2"])
    a, b = (lambda n: F.col(f"a_{n}")), (lambda n: F.col(f"b_{n}"))
    same = c.where(
        (a("house") == b("house")) & (a("kind") == b("kind")) & close(a("street"), b("street"))
        & ((a("town") == "") | (b("town") == "") | close(a("town"), b("town")))
    ).select("a1", "a2", "b1", "b2")
    own = distinct.select(F.col("f1").alias("a1"), F.col("f2").alias("a2"), F.col("f1").alias("b1"), F.col("f2").alias("b2"))
    links = same.unionByName(own)
    holders = scratch.save(values.join(named, "address").select("id", "f1", "f2").distinct(), "holders")
    at_a = links.join(holders.select(F.col("id").alias("ia"), F.col("f1").alias("a1"), F.col("f2").alias("a2")), ["a1", "a2"])
    at_b = at_a.select("ia", "b1", "b2").join(holders.select(F.col("id").alias("ib"), F.col("f1").alias("b1"), F.col("f2").alias("b2")), ["b1", "b2"])
    found = at_b.where("ia <> ib").select(F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b"))
    return found.distinct()


def _keys(frames):
    import pandas as pd
    import xxhash

    for f in frames:
        out = []
        for r in f.itertuples():
            one = min(r.codes) if len(r.codes) else ""
            for code in sorted(r.codes) if len(r.codes) else [one]:
                out += [(r.f1, r.f2, xxhash.xxh3_64_intdigest(k) - 2**63) for k in form_keys(r.street, r.house, r.town, code)]
        yield pd.DataFrame(out, columns=["f1", "f2", "key"]).astype("int64")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return same_building(address_values(table(spark, sf_dir, "pairs")))


def p2_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct address and its plausible forms."""
    return parsed(address_values(table(spark, sf_dir, "pairs")).select("address").distinct())


QUERIES = {"p2_found": p2_found, "p2_forms": p2_forms}
SQL: dict[str, str] = {}
