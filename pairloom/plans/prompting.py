"""Queries on prompts: lookups, selections of examples, requests and answers, and evaluation with errors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.functions import render as T
from pairloom.functions.text import prop
from pairloom.operators import examples as E
from pairloom.operators import metrics as M
from pairloom.operators import predict as A
from pairloom.operators import registry as G
from pairloom.plans import rendering as R
from pairloom.plans import sql as S
from pairloom.plans.evaluation import key_scored
from pairloom.plans.registries import _P, _prompts
from pairloom.session import table


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pairs")


def _files(spark: SparkSession, d: str) -> DataFrame:
    """Prompt files as a table of path and text: those of the scored entries are there."""
    return _prompts(spark, d).where("provenance.dev_f1 is not null and path is not null").select("path", F.concat(F.lit("file of "), "prompt_id").alias("text")).dropDuplicates(["path"])


def prompt_for_models(spark, d):
    """The best prompts, where those of one model stand for all; another model is asked for that has none."""
    p = _prompts(spark, d).withColumn("model", F.when(F.col("model") == "rule-base", "all").otherwise(F.col("model")))
    return G.prompt_for(p.select("model").unionByName(spark.createDataFrame([("unheard-of",)], "model string")), p)


def prompts_by_model(spark, d):
    return G.prompts_of(_prompts(spark, d), model="mid-matcher").select("prompt_id", "model")


def prompts_by_optimizer(spark, d):
    return G.prompts_of(_prompts(spark, d), optimizer="search").select("prompt_id", "model", F.col("provenance.optimizer").alias("optimizer"))


def prompts_with_files(spark, d):
    return G.with_files(_prompts(spark, d).select("prompt_id", "path"), _files(spark, d)).select("prompt_id", F.substring("text", 1, 8).alias("start"))


def run_names(spark, d):
    """Names of runs by the minute of their predictions, and of prompts by model, optimizer and date."""
    return _prompts(spark, d).select("prompt_id", G.prompt_id(F.col("model"), F.col("provenance.optimizer"), F.col("created_date"), F.col("position")).alias("name"))


def run_ids(spark, d):
    return table(spark, d, "predictions").select(G.run_id(F.col("created_at")).alias("name")).distinct()


def random_selection(spark, d):
    return E.select_random(_pairs(spark, d).select("pair_id", "judgement"), 25)


def balanced_selection(spark, d):
    p = _pairs(spark, d)
    return E.select_balanced(p.select("pair_id", "judgement"), 9, p.where("pair_id < 200"))


def examples_examined(spark, d):
    p = _pairs(spark, d)
    return E.examine(E.select_balanced(p, 60))


def example_schemas(spark, d):
    return E.schemas_of(E.select_balanced(_pairs(spark, d), 60))


def tuning_parts(spark, d):
    p = _pairs(spark, d).select("pair_id", "judgement")
    return E.prefix_split(p, "pair_id", p.count()).groupBy("part").agg(F.count("*").alias("n"), F.max("pair_id").alias("last"))


def candidate_grid(spark, d):
    """Thresholds as candidates of a search."""
    scored = key_scored(spark, d)
    return E.best_candidate(E.grid_metrics(scored, "judgement", {f"t{t}": F.col("score") >= t for t in (0.1, 0.3, 0.5, 0.7)}))


def short_reasoning(spark, d):
    return _pairs(spark, d).select("pair_id", T.short_reasoning().alias("reasoning"))


def _examples(spark, d):
    """Two fixed pairs as examples, by their captions."""
    p = _pairs(spark, d).where("pair_id < 2").select("pair_id", "left", "right", "judgement", T.short_reasoning().alias("reasoning"))
    one = F.struct("pair_id", T.format_entity("left").alias("a"), T.format_entity("right").alias("b"), F.coalesce("judgement", F.lit("")).alias("label"), "reasoning")
    return p.agg(F.array_sort(F.collect_list(one)).alias("examples"))


def few_shot_prompts(spark, d):
    user = F.concat(T.numbered_examples(F.col("examples")), T.pair_prompt(T.format_entity("left"), T.format_entity("right"), T.PAIR_SEARCH))
    titled = F.concat(T.titled_examples(F.col("examples")), T.pair_prompt(T.format_entity("left"), T.format_entity("right"), T.PAIR_SEARCH))
    p = _pairs(spark, d).join(F.broadcast(_examples(spark, d)), F.lit(True))
    roles = F.concat(F.transform(T.request(user), lambda m: m["role"]), F.transform(T.request(user, responses_api=True), lambda m: m["role"]))
    return p.select("pair_id", F.md5(user).alias("numbered"), F.md5(titled).alias("titled"), F.array_join(roles, ",").alias("roles"))


def answer_only_prompt(spark, d):
    return _pairs(spark, d).select("pair_id", T.pair_prompt(T.format_entity("left"), T.format_entity("right"), T.PAIR_SEARCH + T.ANSWER_ONLY).alias("prompt"))


def _answers(spark, d):
    """Predictions as models would answer them: JSON, or the text of an error."""
    p = table(spark, d, "predictions")
    raw = F.to_json(F.struct("classification", "confidence", "reasoning"))
    usage = F.struct(F.col("tokens_used.prompt").alias("input_tokens"), F.col("tokens_used.completion").alias("output_tokens"), F.col("tokens_used.total").alias("total_tokens"))
    return p.select("run_id", "pair_index", "ground_truth", F.when(F.col("error").isNull(), raw).otherwise(F.col("error")).alias("raw"), usage.alias("usage"))


def responses_parsed(spark, d):
    a = _answers(spark, d)
    r = a.select("run_id", "pair_index", A.parse_response(F.col("raw")).alias("r"), A.tokens_used(F.col("usage"), responses_api=True).alias("t"))
    return r.select("run_id", "pair_index", "r.classification", "r.confidence", F.col("r.error").isNotNull().alias("failed"), F.col("t.total").alias("total"))


def evaluated_with_errors(spark, d):
    m = M.evaluate_batch(table(spark, d, "predictions"), "ground_truth", "classification", "error", "run_id")
    return m.select("run_id", *M.COUNTS, "n_evaluated", "n_errors")


def experiment_rows(spark, d):
    m = M.evaluate(table(spark, d, "predictions"), "ground_truth", "classification", "run_id")
    e = G.experiment_rows(m, F.lit("model"), F.create_map(F.lit("seed"), F.lit("42")), F.lit(None).cast("string"))
    return e.select("run_id", "method", F.col("params")["seed"].alias("seed"), "metrics.f1", "metrics.confusion_matrix.true_positive")


def entity_stats(spark, d):
    """Per left side what a record holds: numbers of properties, names, datasets, and whether a birth date is there."""
    n = lambda k: F.size(prop("left", k))
    return _pairs(spark, d).select(
        "pair_id", F.coalesce(F.size(F.map_keys("left.properties")), F.lit(0)).alias("n_fields"), (n("name") + n("alias")).alias("n_names"),
        F.coalesce(F.size("left.datasets"), F.lit(0)).alias("n_datasets"), (n("birthDate") > 0).alias("has_birth_date"),
    )


def filled_shares(spark, d):
    """Per property the share of left sides with a value that isn't blank."""
    p = _pairs(spark, d)
    rows = p.select(F.explode("left.properties").alias("field", "vs")).where(F.exists("vs", lambda v: F.coalesce(F.trim(v) != "", F.lit(False))))
    return rows.groupBy("field").agg((F.count("*") / F.lit(float(max(p.count(), 1)))).alias("share"))


def fields_of_one_side(spark, d):
    """Properties on left sides of negative pairs, but never on right sides of positive ones."""
    p = _pairs(spark, d)
    keys = lambda e, j: p.where(F.col("judgement") == j).select(F.explode(F.map_keys(f"{e}.properties")).alias("field"))
    return keys("left", "negative").subtract(keys("right", "positive").where("field < 'n'"))


def most_common_positions(spark, d):
    v = _pairs(spark, d).select(F.explode(prop("left", "position")).alias("position"))
    return v.groupBy("position").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "position").limit(5)


_FUNCTIONS = [
    prompt_for_models, prompts_by_model, prompts_by_optimizer, prompts_with_files, run_names, run_ids, random_selection, balanced_selection, examples_examined,
    example_schemas, tuning_parts, candidate_grid, short_reasoning, few_shot_prompts, answer_only_prompt, responses_parsed, evaluated_with_errors, experiment_rows,
    entity_stats, filled_shares, fields_of_one_side, most_common_positions,
]
QUERIES = {f.__name__: f for f in _FUNCTIONS}

_q = R._q
_ORDER = "md5('42|' || pair_id::VARCHAR), pair_id"
_BALANCED = "(SELECT * FROM pairs WHERE judgement = 'positive'{w} ORDER BY {o} LIMIT {a}) UNION ALL (SELECT * FROM pairs WHERE judgement = 'negative'{w} ORDER BY {o} LIMIT {b})"


def _balanced(n: int, where: str = "") -> str:
    return _BALANCED.format(w=where, o=_ORDER, a=n // 2, b=n - n // 2)


def _short() -> str:
    both = lambda k: f"len({S.prop('left', k)}) > 0 AND len({S.prop('right', k)}) > 0"
    join = lambda xs: f"array_to_string([x for x in [{', '.join(xs)}] if x IS NOT NULL], ', ')"
    yes = join([f"CASE WHEN {both(k)}{'' if k == 'name' else f' AND {R._hit(k)}'} THEN '{t}' END" for k, t in T.SHORT_MATCHES])
    no = join([f"CASE WHEN {both(k)} AND NOT {R._hit(k)} THEN '{t}' END" for k, t in T.SHORT_CONFLICTS])
    (p1, p2), (n1, n2) = ([*t[0].split("{}")] for t in (T.SHORT_POSITIVE, T.SHORT_NEGATIVE))
    return f"""CASE WHEN judgement = 'positive' THEN CASE WHEN {yes} <> '' THEN {_q(p1)} || upper(({yes})[1:1]) || ({yes})[2:] || {_q(p2)} ELSE {_q(T.SHORT_POSITIVE[1])} END
      WHEN {no} <> '' THEN {_q(n1)} || {no} || {_q(n2)} ELSE {_q(T.SHORT_NEGATIVE[1])} END"""


def _fill(template: str, *values: str) -> str:
    parts = template.split("{}")
    return " || ".join([_q(parts[0])] + [f"coalesce({v}, '') || {_q(t)}" for v, t in zip(values, parts[1:])])


_PAIR = f"{_q(T.PAIR_HEAD)} || {R._entity('left')} || {_q(T.PAIR_MIDDLE)} || {R._entity('right')} || {_q(T.PAIR_SEARCH)}"
_EXAMPLES = f"""ex AS (SELECT pair_id, {R._entity('left')} AS a, {R._entity('right')} AS b, coalesce(judgement, '') AS label, {_short()} AS reasoning FROM pairs WHERE pair_id < 2),
  blocks AS (SELECT string_agg({_fill(T.NUMBERED['example'], '(pair_id + 1)::VARCHAR', 'a', 'b', 'label', 'reasoning')}, {_q(T.NUMBERED['between'])} ORDER BY pair_id) AS n,
    string_agg({_fill(T.TITLED['example'], 'a', 'b', 'label', f"CASE WHEN label = 'positive' THEN {_q(T.TITLED_REASONS['positive'])} ELSE {_q(T.TITLED_REASONS['negative'])} END")}, {_q(T.TITLED['between'])} ORDER BY pair_id) AS t FROM ex)"""
_SCORED = "WITH scored AS ({scored}), c AS (SELECT unnest([0.1, 0.3, 0.5, 0.7]) AS t)"


def _grid() -> str:
    from pairloom.plans.evaluation import SQL as E_SQL

    counts = f"SELECT 't' || t::VARCHAR AS candidate, {S.cells('judgement', chr(39) + 'positive' + chr(39)).replace(chr(39) + 'positive' + chr(39) + ' = ' + chr(39) + 'positive' + chr(39), 'score >= t::DOUBLE')} FROM scored, c GROUP BY t"
    return _SCORED.format(scored=E_SQL["key_scored"]) + " " + S.with_f1(counts, "candidate") + " ORDER BY f1 DESC, candidate LIMIT 1"


_SAID = "error IS NULL AND coalesce(classification IN ('positive', 'negative', 'uncertain'), false)"
_ANSWERED = "ground_truth IS NOT NULL AND classification IS NOT NULL AND classification <> 'error' AND error IS NULL"
_T, _C = "coalesce(ground_truth = 'positive', false)", "coalesce(classification = 'positive', false)"

SQL = {
    "prompt_for_models": f"""{_P.replace("SELECT *,", "SELECT * REPLACE (CASE WHEN model = " + _q("rule-base") + " THEN " + _q("all") + " ELSE model END AS model),")}, best AS (SELECT model, prompt_id, coalesce(provenance.dev_f1, 0) AS score FROM p QUALIFY row_number() OVER (PARTITION BY model ORDER BY coalesce(provenance.dev_f1, 0) DESC, position) = 1),
      asked AS (SELECT DISTINCT model FROM p WHERE model IS NOT NULL UNION SELECT 'unheard-of'), shared AS (SELECT * FROM best WHERE model = 'all')
      SELECT a.model, coalesce(b.prompt_id, s.prompt_id) AS prompt_id, CASE WHEN b.prompt_id IS NULL THEN s.score ELSE b.score END AS score FROM asked a LEFT JOIN best b ON a.model = b.model LEFT JOIN shared s ON true""",
    "prompts_by_model": f"{_P} SELECT prompt_id, model FROM p WHERE model = 'mid-matcher'",
    "prompts_by_optimizer": f"{_P} SELECT prompt_id, model, provenance.optimizer AS optimizer FROM p WHERE provenance.optimizer = 'search'",
    "prompts_with_files": f"{_P} SELECT prompt_id, 'file of ' AS start FROM p WHERE path IN (SELECT path FROM p WHERE provenance.dev_f1 IS NOT NULL)",
    "run_names": f"{_P} SELECT prompt_id, concat_ws('_', model, provenance.optimizer, replace(created_date, '-', ''), 'v' || position::VARCHAR) AS name FROM p",
    "run_ids": "SELECT DISTINCT strftime(created_at, '%Y%m%d_%H%M%S') AS name FROM predictions",
    "random_selection": f"SELECT pair_id, judgement FROM pairs ORDER BY {_ORDER} LIMIT 25",
    "balanced_selection": f"SELECT pair_id, judgement FROM ({_balanced(9, ' AND pair_id >= 200')})",
    "examples_examined": f"""SELECT count(*) AS total, count(*) FILTER (judgement = 'positive') AS positive, count(*) FILTER (judgement <> 'positive') AS negative,
      (count(*) FILTER (judgement = 'positive'))::DOUBLE / count(*) AS positive_ratio, """
    + ", ".join(f"count(*) FILTER (list_contains(map_keys(\"left\".properties), '{k}')) AS has_{k}" for k in ("birthDate", "country", "idNumber")) + f" FROM ({_balanced(60)})",
    "example_schemas": f"SELECT coalesce(\"left\".schema, 'Unknown') AS schema, count(*) AS n FROM ({_balanced(60)}) GROUP BY 1",
    "tuning_parts": "SELECT CASE WHEN pair_id < CAST(floor(0.8 * (SELECT count(*) FROM pairs)) AS BIGINT) THEN 'tune' ELSE 'validate' END AS part, count(*) AS n, max(pair_id) AS last FROM pairs GROUP BY 1",
    "candidate_grid": _grid(),
    "short_reasoning": f"SELECT pair_id, {_short()} AS reasoning FROM pairs",
    "few_shot_prompts": f"""WITH {_EXAMPLES} SELECT pair_id, md5({_q(T.NUMBERED['head'])} || n || {_q(T.NUMBERED['foot'])} || {_PAIR}) AS numbered,
      md5({_q(T.TITLED['head'])} || t || {_q(T.TITLED['foot'])} || {_PAIR}) AS titled, 'system,user,developer,user' AS roles FROM pairs, blocks""",
    "answer_only_prompt": f"SELECT pair_id, {_PAIR} || {_q(T.ANSWER_ONLY)} AS prompt FROM pairs",
    "responses_parsed": f"""SELECT run_id, pair_index, CASE WHEN {_SAID} THEN classification ELSE 'error' END AS classification, CASE WHEN error IS NULL THEN confidence END AS confidence,
      NOT ({_SAID}) AS failed, tokens_used.total AS total FROM predictions""",
    "evaluated_with_errors": f"""SELECT run_id, count(*) FILTER ({_ANSWERED} AND {_T} AND {_C}) AS true_positive, count(*) FILTER ({_ANSWERED} AND NOT {_T} AND {_C}) AS false_positive,
      count(*) FILTER ({_ANSWERED} AND {_T} AND NOT {_C}) AS false_negative, count(*) FILTER ({_ANSWERED} AND NOT {_T} AND NOT {_C}) AS true_negative,
      count(*) FILTER ({_ANSWERED}) AS n_evaluated, count(*) FILTER (error IS NOT NULL OR coalesce(classification = 'error', false)) AS n_errors FROM predictions GROUP BY run_id""",
    "experiment_rows": "SELECT run_id, 'model' AS method, '42' AS seed, f1, true_positive FROM (" + S.with_f1(f"SELECT run_id, {S.cells('ground_truth', 'classification')} FROM predictions GROUP BY run_id", "run_id") + ")",
    "entity_stats": f"""SELECT pair_id, CAST(coalesce(len(map_keys("left".properties)), 0) AS INT) AS n_fields, CAST(len({S.prop('left', 'name')}) + len({S.prop('left', 'alias')}) AS INT) AS n_names,
      CAST(coalesce(len("left".datasets), 0) AS INT) AS n_datasets, len({S.prop('left', 'birthDate')}) > 0 AS has_birth_date FROM pairs""",
    "filled_shares": """SELECT field, count(*)::DOUBLE / (SELECT count(*) FROM pairs) AS share FROM (SELECT m.key AS field, m.value AS vs FROM (SELECT unnest(map_entries("left".properties)) AS m FROM pairs))
      WHERE len([v for v in vs if trim(v) <> '']) > 0 GROUP BY 1""",
    "fields_of_one_side": """SELECT DISTINCT unnest(map_keys("left".properties)) AS field FROM pairs WHERE judgement = 'negative'
      EXCEPT SELECT field FROM (SELECT unnest(map_keys("right".properties)) AS field FROM pairs WHERE judgement = 'positive') WHERE field < 'n'""",
    "most_common_positions": f"SELECT position, count(*) AS n FROM (SELECT unnest({S.prop('left', 'position')}) AS position FROM pairs) GROUP BY 1 ORDER BY n DESC, position LIMIT 5",
}
