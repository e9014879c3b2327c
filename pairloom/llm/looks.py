"""Queries p7: text that looks the same but is made of different characters, brought to one form.

The form is SQL that DuckDB runs over Arrow batches inside Spark's tasks: characters without width are dropped,
compatibility forms, spaces and look-alike letters mapped one for one, ligatures spelled out, the result composed (NFC),
blanks at its ends and runs of them reduced. Case, spelling, word order and missing accents stay as they are.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.llm.textforms import LOOKALIKES, invisible, multi_forms, single_forms
from pairloom.operators.entities import real_id, sides
from pairloom.session import Scratch, table


#: Forms that names are often typed in: full-width signs and letters.
USUAL = frozenset(map(chr, range(0xFF01, 0xFF5F)))


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def form_sql(column: str) -> str:
    """The DuckDB expression for the form of a text column; null stays null."""
    forms, several = single_forms(), multi_forms()
    usual = {a: b for a, b in forms.items() if a in LOOKALIKES or a in USUAL or unicodedata.category(a) in ("Zs", "Cc")}
    rare = {a: b for a, b in forms.items() if a not in usual}
    swap = lambda x, t: f"translate({x}, {quoted(''.join(t))}, {quoted(''.join(t.values()))})"
    x = swap(f"regexp_replace({column}, {quoted(char_class(invisible()))}, '', 'g')", usual)
    spelled = swap(x, rare)
    for a, b in several.items():
        spelled = f"replace({spelled}, {quoted(a)}, {quoted(b)})"
    # translate reads its whole table for each value: the long one only where a value has a character of it
    x = f"CASE WHEN regexp_matches({column}, {quoted(char_class([*rare, *several]))}) THEN {spelled} ELSE {x} END"
    tidy = lambda y: f"trim(regexp_replace({y}, ' +', ' ', 'g'))"
    return f"CASE WHEN regexp_full_match({column}, '[ -~]*') THEN {tidy(column)} ELSE {tidy(f'nfc_normalize({x})')} END"


def char_class(chars) -> str:
    """A regular expression's class of characters, written with escapes, so that none is lost on the way."""
    ranges, run = [], None
    for c in sorted(map(ord, set(chars))):
        if run and c == run[1] + 1:
            run[1] = c
        else:
            ranges.append(run := [c, c])
    return "[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in ranges) + "]"


def with_form(df: DataFrame, column: str, out: str) -> DataFrame:
    """``df`` and, as ``out``, the form of a text column. Null gives null, blank gives empty text."""
    schema = T.StructType([f for f in df.schema.fields if f.name != out] + [T.StructField(out, T.StringType())])
    names = [f.name for f in schema.fields][:-1]
    cols = ", ".join('"' + n.replace('"', '""') + '"' for n in names)
    sql = f"SELECT {cols}, {form_sql('"' + column + '"')} AS \"{out}\" FROM batch_rows"

    def run(batches):
        import duckdb
        import pyarrow as pa

        con = duckdb.connect(config={"threads": 1})
        for batch in batches:
            if batch.num_rows:
                con.register("batch_rows", pa.Table.from_batches([batch]))
                res = con.sql(sql).to_arrow_table()
                con.unregister("batch_rows")
                yield from res.to_batches()

    return df.select(*names).mapInArrow(run, schema)


def name_values(pairs: DataFrame) -> DataFrame:
    """``id``, ``value``: the distinct non-blank values of caption, name and alias of each id, over all its versions."""
    p = F.col("e.properties")
    some = lambda k: F.coalesce(F.try_element_at(p, F.lit(k)), F.array().cast("array<string>"))
    every: Column = F.array_distinct(F.concat(F.array("e.caption"), some("name"), some("alias")))
    s = sides(pairs).select(real_id(F.col("e.id")).alias("id"), F.explode(every).alias("value"))
    return s.where("id is not null and trim(value) <> ''").distinct()


def same_look(values: DataFrame) -> DataFrame:
    """``id_a``, ``id_b``, smaller first: ids with values that look the same but aren't the same string.

    ``values`` has ``id`` and ``value``. Only looks that at least two strings share go on. Strings are paired first and
    ids joined to the pairs, so a name that thousands of ids write alike makes no pairs among them.
    """
    scratch = Scratch(values.sparkSession, "looks")
    formed = scratch.save(with_form(values.select("id", "value"), "value", "form"), "forms")
    shared = formed.groupBy("form").agg(F.min("value").alias("a"), F.max("value").alias("b")).where("a <> b and form <> ''")
    kept = scratch.save(formed.join(shared.select("form"), "form", "left_semi"), "shared")
    strings = kept.select("form", "value").distinct()
    left, right = strings.select("form", F.col("value").alias("va")), strings.select("form", F.col("value").alias("vb"))
    both = left.join(right, "form").where("va < vb").select("va", "vb")
    who = kept.select("id", "value")
    at_a = both.join(who.select(F.col("id").alias("ia"), F.col("value").alias("va")), "va").select("vb", "ia")
    at_b = at_a.join(who.select(F.col("id").alias("ib"), F.col("value").alias("vb")), "vb").where("ia <> ib")
    return at_b.select(F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b")).distinct()


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return same_look(name_values(table(spark, sf_dir, "pairs")))


def p7_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct value and its form."""
    return with_form(name_values(table(spark, sf_dir, "pairs")).select("value").distinct(), "value", "form")


QUERIES = {"p7_found": p7_found, "p7_forms": p7_forms}

_VALUES = """
WITH sides AS (SELECT unnest(["left", "right"]) AS e FROM pairs),
vals AS (
  SELECT DISTINCT e.id AS id, v AS value FROM (
    SELECT e, unnest([e.caption] || coalesce(e.properties['name'], []) || coalesce(e.properties['alias'], [])) AS v FROM sides)
  WHERE e.id <> '' AND trim(v) <> '')
"""

SQL = {
    "p7_found": _VALUES + f"""
, forms AS (SELECT id, value, {form_sql('value')} AS form FROM vals)
SELECT DISTINCT least(a.id, b.id) AS id_a, greatest(a.id, b.id) AS id_b
FROM forms a JOIN forms b ON a.form = b.form AND a.value < b.value AND a.id <> b.id WHERE a.form <> ''""",
    "p7_forms": _VALUES + f", v AS (SELECT DISTINCT value FROM vals) SELECT value, {form_sql('value')} AS form FROM v",
}
