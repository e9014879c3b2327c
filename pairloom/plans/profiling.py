"""Queries that profile the pair table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.functions import text as X
from pairloom.functions.similarity import shared_fields
from pairloom.operators import entities as E
from pairloom.operators import profile as P
from pairloom.plans import sql as S
from pairloom.session import table

CUTOFF = "2023-01-01"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pairs")


def pair_scan_count(spark, d):
    return E.sides(_pairs(spark, d)).groupBy("side").agg(F.count("*").alias("n"), F.count("e.id").alias("n_ids"))


def name_token_key(spark, d):
    v = _pairs(spark, d).select(F.explode(X.prop("left", "name")).alias("name")).distinct()
    return v.select("name", X.normalize_text(F.col("name")).alias("norm"), X.token_key(F.col("name")).alias("key"))


def entity_first_seen(spark, d):
    return E.first_seen(_pairs(spark, d)).select("id", "e.caption", "e.schema")


def entity_incidence(spark, d):
    return E.incidence(_pairs(spark, d)).groupBy("id").agg(F.count("*").alias("n_pairs"))


def unique_entities(spark, d):
    return E.sides(_pairs(spark, d)).agg(F.count_distinct(F.nullif("e.id", F.lit(""))).alias("n"))


def schema_counts(spark, d):
    return P.shares(E.first_seen(_pairs(spark, d)).select(F.coalesce("e.schema", F.lit("Unknown")).alias("schema")), "schema")


def _dataset_counts(spark, d):
    return E.first_seen(_pairs(spark, d)).select(F.explode("e.datasets").alias("dataset")).groupBy("dataset").agg(F.count("*").alias("n"))


def dataset_counts(spark, d):
    return _dataset_counts(spark, d)


def source_gini(spark, d):
    return P.gini(_dataset_counts(spark, d), "n")


def topk_share(spark, d):
    c = _dataset_counts(spark, d)
    top = c.orderBy(F.desc("n"), "dataset").limit(10).agg(F.sum("n").alias("top"))
    return top.crossJoin(c.agg(F.sum("n").alias("total"))).select((F.col("top") / F.col("total")).alias("share"))


def countries_of_datasets(spark, d):
    names = E.sides(_pairs(spark, d)).select(F.explode("e.datasets").alias("dataset")).distinct()
    return names.select("dataset", X.country_basic(F.col("dataset")).alias("basic"), X.country_extended(F.col("dataset")).alias("extended"))


def datasets_per_country(spark, d):
    return countries_of_datasets(spark, d).groupBy("extended").agg(F.count("*").alias("n"))


def property_counts(spark, d):
    """Per first-seen entity the number of its properties, described."""
    e = E.first_seen(_pairs(spark, d)).select(F.coalesce(F.size(F.map_keys("e.properties")), F.lit(0)).alias("n_fields"))
    return P.describe(e, "n_fields")


def length_stats(spark, d):
    v = P.field_values(_pairs(spark, d)).select("field", F.char_length("value").alias("length"))
    return P.describe(v, "length", "field")


def longest_fields(spark, d):
    return length_stats(spark, d).orderBy(F.desc("mean"), "field").limit(15).select("field", "mean", "n")


def completeness(spark, d):
    return P.completeness(_pairs(spark, d))


def field_universe(spark, d):
    return E.sides(_pairs(spark, d)).select(F.explode(F.map_keys("e.properties")).alias("field")).distinct()


def schema_combos(spark, d):
    s = lambda e: F.coalesce(F.col(f"{e}.schema"), F.lit("Unknown"))
    return P.combos(_pairs(spark, d), s("left"), s("right"), E.positive(F.col("judgement")), "combo")


def _scripts(spark, d):
    p = _pairs(spark, d).select("pair_id", "judgement", X.scripts(F.col("left.caption")).alias("l"), X.scripts(F.col("right.caption")).alias("r"))
    fix = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    return p.withColumns({"l": fix(F.col("l")), "r": fix(F.col("r"))})


def script_detect(spark, d):
    s = _scripts(spark, d)
    return s.select(
        "pair_id", F.array_join("l", "|").alias("left_scripts"), F.array_join("r", "|").alias("right_scripts"), X.primary_script(F.col("l")).alias("left_primary"),
        (F.col("l") != F.col("r")).alias("differ"), (X.any_non_latin(F.col("l")) | X.any_non_latin(F.col("r"))).alias("any_non_latin"),
    )


def script_appearances(spark, d):
    return _scripts(spark, d).select(F.explode(F.array_union("l", "r")).alias("script")).groupBy("script").agg(F.count("*").alias("n"))


def primary_script_combos(spark, d):
    key = F.array_join(F.array_sort(F.array_distinct(F.array(X.primary_script(F.col("l")), X.primary_script(F.col("r"))))), "|")
    return _scripts(spark, d).groupBy(key.alias("combo")).agg(F.count("*").alias("n"))


def shared_field_counts(spark, d):
    p = _pairs(spark, d).select(E.positive(F.col("judgement")).alias("positive"), F.size(shared_fields()).alias("n_shared"))
    return p.groupBy("positive", "n_shared").agg(F.count("*").alias("n"))


def cross_source(spark, d):
    c = P.cross_source(F.col("left.datasets"), F.col("right.datasets")).alias("cross")
    return _pairs(spark, d).groupBy(c, E.positive(F.col("judgement")).alias("positive")).agg(F.count("*").alias("n"))


def cross_country_positives(spark, d):
    p = _pairs(spark, d).where(E.positive(F.col("judgement")) & P.cross_source(X.prop("left", "country"), X.prop("right", "country")))
    return p.agg(F.count("*").alias("n"))


def temporal_holdout(spark, d):
    seen = lambda e: F.substring(F.col(f"{e}.first_seen"), 1, 10)
    late = (F.least(seen("left"), seen("right")) >= CUTOFF) & (seen("left") != "") & (seen("right") != "")
    return _pairs(spark, d).where(late).groupBy(E.positive(F.col("judgement")).alias("positive")).agg(F.count("*").alias("n"))


def first_seen_by_year(spark, d):
    e = E.first_seen(_pairs(spark, d)).where("e.first_seen <> ''")
    return e.groupBy(F.substring("e.first_seen", 1, 4).alias("year")).agg(F.count("*").alias("n"))


def listing_span(spark, d):
    e = E.first_seen(_pairs(spark, d))
    day = lambda c: F.nullif(F.substring(f"e.{c}", 1, 10), F.lit(""))
    return e.agg(F.min(day("first_seen")).alias("first"), F.max(day("last_seen")).alias("last"))


def alias_flags(spark, d):
    e = E.first_seen(_pairs(spark, d))
    n = lambda k: F.size(X.prop("e", k))
    return e.agg(
        F.avg(((n("alias") > 0) | (n("weakAlias") > 0)).cast("int")).alias("share_with_alias"),
        F.avg(n("name") + n("alias") + n("weakAlias")).alias("mean_names"),
    )


def names_of_first(spark, d):
    return E.first_seen(_pairs(spark, d)).select("id", F.to_json(X.names_of("e")).alias("names"))


_FUNCTIONS = [
    pair_scan_count, name_token_key, entity_first_seen, entity_incidence, unique_entities, schema_counts, dataset_counts, source_gini, topk_share,
    countries_of_datasets, datasets_per_country, property_counts, length_stats, longest_fields, completeness, field_universe, schema_combos, script_detect,
    script_appearances, primary_script_combos, shared_field_counts, cross_source, cross_country_positives, temporal_holdout, first_seen_by_year, listing_span,
    alias_flags, names_of_first,
]
QUERIES = {f.__name__: f for f in _FUNCTIONS}

_POS = S.positive("judgement")
_DATASETS = f"WITH {S.FIRST}, ds AS (SELECT unnest(e.datasets) AS dataset FROM firsts), c AS (SELECT dataset, count(*) AS n FROM ds WHERE dataset IS NOT NULL GROUP BY 1)"


def _map(n: int | None) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in list(X.COUNTRIES.items())[:n]) + "}"


_COUNTRY = f"""SELECT dataset,
  coalesce({_map(X.BASIC_COUNTRIES)}[CASE WHEN dataset[3] = '_' THEN lower(dataset[1:2]) END], '{X.ELSEWHERE}') AS basic,
  coalesce({_map(None)}[lower(CASE WHEN contains(dataset, '_') THEN split_part(dataset, '_', 1) ELSE dataset[1:2] END)], '{X.ELSEWHERE}') AS extended
  FROM (SELECT DISTINCT unnest(e.datasets) AS dataset FROM sides) WHERE dataset IS NOT NULL"""


def _describe(rows: str, by: str = "") -> str:
    k = f"{by}, " if by else ""
    g = f"GROUP BY {by}" if by else ""
    return f"""SELECT {k}count(*) AS n, avg(v) AS mean, median(v)::DOUBLE AS median, list_sort(list(v))[count(*) // 4 + 1] AS p25,
      list_sort(list(v))[least(count(*) - 1, 3 * count(*) // 4) + 1] AS p75, max(v) AS max, min(v) AS min FROM ({rows}) {g}"""


_VALUES = """SELECT unnest(map_entries(p)) AS m FROM (SELECT unnest(["left".properties, "right".properties]) AS p FROM pairs)"""
_LENGTHS = f"SELECT field, length(v) AS v FROM (SELECT m.key AS field, unnest(m.value) AS v FROM ({_VALUES})) WHERE v IS NOT NULL"
# letters of the scripts that occur in captions: Latin, Cyrillic, Greek
_SCRIPT_CLASSES = {
    "Cyrillic": r"[\x{400}-\x{481}\x{48a}-\x{52f}]", "Greek": r"[\x{370}-\x{373}\x{376}\x{377}\x{37a}-\x{37d}\x{37f}\x{386}\x{388}-\x{3ff}]",
    "Latin": r"[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}\x{1e00}-\x{1eff}]",
}


def _scripts_sql(x: str) -> str:
    return "[s for s in [" + ", ".join(f"CASE WHEN regexp_matches({x}, '{c}') THEN '{n}' END" for n, c in _SCRIPT_CLASSES.items()) + "] if s IS NOT NULL]"


_SCRIPTED = f"""WITH sc AS (SELECT pair_id, {_scripts_sql('"left".caption')} AS l, {_scripts_sql('"right".caption')} AS r FROM pairs)"""
_SHARED = """len([k for k in map_keys("left".properties) if coalesce(list_has_any("left".properties[k], coalesce("right".properties[k], [])), false)])"""


def _cross(l: str, r: str) -> str:
    return f"coalesce(len({l}), 0) > 0 AND coalesce(len({r}), 0) > 0 AND NOT coalesce(list_has_any({l}, {r}), false)"


_N = "CAST(count(*) FILTER ({}) AS BIGINT)"
SQL = {
    "pair_scan_count": f"WITH {S.SIDES} SELECT side, count(*) AS n, count(e.id) AS n_ids FROM sides GROUP BY side",
    "name_token_key": f"SELECT name, {S.norm('name')} AS norm, {S.token_key('name')} AS key FROM (SELECT DISTINCT unnest({S.prop('left', 'name')}) AS name FROM pairs)",
    "entity_first_seen": f"WITH {S.FIRST} SELECT id, e.caption AS caption, e.schema AS schema FROM firsts",
    "entity_incidence": f"WITH {S.SIDES} SELECT e.id AS id, count(DISTINCT pair_id) AS n_pairs FROM sides WHERE e.id <> '' GROUP BY 1",
    "unique_entities": f"WITH {S.SIDES} SELECT count(DISTINCT nullif(e.id, '')) AS n FROM sides",
    "schema_counts": f"WITH {S.FIRST} SELECT coalesce(e.schema, 'Unknown') AS schema, count(*) AS n, count(*) / (SELECT count(*) FROM firsts)::DOUBLE AS share FROM firsts GROUP BY 1",
    "dataset_counts": f"{_DATASETS} SELECT dataset, n FROM c",
    "source_gini": f"{_DATASETS} SELECT coalesce(2.0::DOUBLE * sum(i * n) / (count(*) * sum(n)) - (count(*) + 1)::DOUBLE / count(*), 0.0) AS gini FROM (SELECT n, row_number() OVER (ORDER BY n) AS i FROM c)",
    "topk_share": f"{_DATASETS} SELECT (SELECT sum(n) FROM (SELECT n FROM c ORDER BY n DESC, dataset LIMIT 10))::DOUBLE / (SELECT sum(n) FROM c) AS share",
    "countries_of_datasets": f"WITH {S.SIDES} {_COUNTRY}",
    "datasets_per_country": f"WITH {S.SIDES} SELECT extended, count(*) AS n FROM ({_COUNTRY}) GROUP BY 1",
    "property_counts": f"WITH {S.FIRST} " + _describe("SELECT coalesce(cardinality(e.properties), 0) AS v FROM firsts"),
    "length_stats": _describe(_LENGTHS, "field"),
    "longest_fields": f"SELECT field, mean, n FROM ({_describe(_LENGTHS, 'field')}) ORDER BY mean DESC, field LIMIT 15",
    "completeness": """WITH f AS (SELECT side, m.key AS field, m.value AS vs FROM (
        SELECT 'left' AS side, unnest(map_entries("left".properties)) AS m FROM pairs UNION ALL SELECT 'right', unnest(map_entries("right".properties)) FROM pairs)), n AS (SELECT count(*)::DOUBLE AS n FROM pairs)
      SELECT field, count(*) FILTER (side = 'left' AND len(vs) > 0) / any_value(n) AS left_share, count(*) FILTER (side = 'right' AND len(vs) > 0) / any_value(n) AS right_share,
        count(*) FILTER (len(vs) > 0) / (2 * any_value(n)) AS mean_share FROM f, n GROUP BY field""",
    "field_universe": f"SELECT DISTINCT m.key AS field FROM ({_VALUES})",
    "schema_combos": f"""SELECT least(l, r) || '|' || greatest(l, r) AS combo, count(*) AS n, {_N.format('p')} AS n_positive, {_N.format('NOT p')} AS n_other
      FROM (SELECT coalesce("left".schema, 'Unknown') AS l, coalesce("right".schema, 'Unknown') AS r, {_POS} AS p FROM pairs) GROUP BY 1""",
    "script_detect": f"""{_SCRIPTED} SELECT pair_id, array_to_string(l, '|') AS left_scripts, array_to_string(r, '|') AS right_scripts, coalesce(l[1], 'Unknown') AS left_primary,
      l <> r AS differ, (len(l) > 0 AND l <> ['Latin']) OR (len(r) > 0 AND r <> ['Latin']) AS any_non_latin FROM sc""",
    "script_appearances": f"{_SCRIPTED} SELECT script, count(*) AS n FROM (SELECT DISTINCT pair_id, unnest(l || r) AS script FROM sc) GROUP BY 1",
    "primary_script_combos": f"""{_SCRIPTED} SELECT CASE WHEN a = b THEN a ELSE least(a, b) || '|' || greatest(a, b) END AS combo, count(*) AS n
      FROM (SELECT coalesce(l[1], 'Unknown') AS a, coalesce(r[1], 'Unknown') AS b FROM sc) GROUP BY 1""",
    "shared_field_counts": f'SELECT {_POS} AS positive, CAST(coalesce({_SHARED}, 0) AS INT) AS n_shared, count(*) AS n FROM pairs GROUP BY 1, 2',
    "cross_source": f"""SELECT {_cross('"left".datasets', '"right".datasets')} AS cross, {_POS} AS positive, count(*) AS n FROM pairs GROUP BY 1, 2""",
    "cross_country_positives": f"SELECT count(*) AS n FROM pairs WHERE {_POS} AND {_cross(S.prop('left', 'country'), S.prop('right', 'country'))}",
    "temporal_holdout": f"""SELECT {_POS} AS positive, count(*) AS n FROM pairs WHERE "left".first_seen[1:10] >= '{CUTOFF}' AND "right".first_seen[1:10] >= '{CUTOFF}' GROUP BY 1""",
    "first_seen_by_year": f"WITH {S.FIRST} SELECT e.first_seen[1:4] AS year, count(*) AS n FROM firsts WHERE e.first_seen <> '' GROUP BY 1",
    "listing_span": f"WITH {S.FIRST} SELECT min(nullif(e.first_seen[1:10], '')) AS first, max(nullif(e.last_seen[1:10], '')) AS last FROM firsts",
    "alias_flags": f"""WITH {S.FIRST} SELECT avg((len({S.prop('e', 'alias')}) > 0 OR len({S.prop('e', 'weakAlias')}) > 0)::INT) AS share_with_alias,
      avg(len({S.prop('e', 'name')}) + len({S.prop('e', 'alias')}) + len({S.prop('e', 'weakAlias')})) AS mean_names FROM firsts""",
    "names_of_first": f"""WITH {S.FIRST} SELECT id, CAST(to_json([v for v in {' || '.join(S.prop('e', k) for k in X.NAME_KEYS)} if {S.norm('v')} <> '']) AS VARCHAR) AS names FROM firsts""",
}
