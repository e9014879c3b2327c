"""Queries that render entities and pairs as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.functions import render as T
from pairloom.plans import sql as S
from pairloom.session import table


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pairs")


def format_entity(spark, d):
    return _pairs(spark, d).select("pair_id", T.format_entity("left").alias("left_text"), T.format_entity("right").alias("right_text"))


def format_entity_prompt(spark, d):
    return _pairs(spark, d).select("pair_id", T.format_entity_for_prompt("left").alias("left_text"))


def format_entity_short(spark, d):
    return _pairs(spark, d).select("pair_id", T.format_entity_for_prompt("right", 3).alias("right_text"))


def chat_messages(spark, d):
    p = T.pair_prompt(T.format_entity_for_prompt("left"), T.format_entity_for_prompt("right"))
    m = T.messages(("system", F.lit(T.SYSTEM)), ("user", p), ("assistant", F.coalesce("judgement", F.lit(""))))
    return _pairs(spark, d).select("pair_id", F.array_join(F.transform(m, lambda x: F.concat(x["role"], F.lit(": "), x["content"])), "\n---\n").alias("chat"))


def reasoning_text(spark, d):
    return _pairs(spark, d).select("pair_id", T.reasoning().alias("reasoning"))


def _record(kind):
    def run(spark, d):
        return _pairs(spark, d).select("pair_id", F.to_json(T.training_record(kind)).alias("record"))

    return run


def token_estimate(spark, d):
    """A fourth of a prompt's characters, summed up."""
    p = T.pair_prompt(T.format_entity("left"), T.format_entity("right"), T.PAIR_SEARCH)
    return _pairs(spark, d).agg(F.sum(F.floor(F.char_length(p) / 4)).alias("tokens"))


QUERIES = {
    "format_entity": format_entity, "format_entity_prompt": format_entity_prompt, "format_entity_short": format_entity_short, "chat_messages": chat_messages,
    "reasoning_text": reasoning_text, "sft_openai": _record("openai"), "sft_alpaca": _record("alpaca"), "sft_sharegpt": _record("sharegpt"),
    "token_estimate": token_estimate,
}


def _entity(e: str) -> str:
    lines = [f"'Type: ' || coalesce(\"{e}\".schema, 'Unknown')"]
    for k, label, limit, sep in T.FIELDS:
        v = f"\"{e}\".properties['{k}']"
        shown = f"{v}[1:{limit}]" if limit else v
        lines.append(f"CASE WHEN list_contains(map_keys(\"{e}\".properties), '{k}') THEN '{label}: ' || coalesce(array_to_string({shown}, '{sep}'), '') END")
    return f"array_to_string([x for x in [{', '.join(lines)}] if x IS NOT NULL], chr(10))"


def _prompt(e: str, most: int = 10) -> str:
    lines = [f"'Type: ' || coalesce(\"{e}\".schema, 'Unknown')"]
    for k, label, limit, _ in T.FIELDS:
        if k != "address":
            v = S.prop(e, k) + (f"[1:{limit}]" if limit else "")
            text = f"array_to_string([y for y in {v} if y <> ''], ', ')"
            lines.append(f"CASE WHEN {text} <> '' THEN '{label}: ' || {text} END")
    return f"array_to_string([x for x in [{', '.join(lines)}] if x IS NOT NULL][1:{most + 1}], chr(10))"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _both(k: str) -> str:
    return " AND ".join(f"coalesce(list_contains(map_keys(\"{e}\".properties), '{k}'), false)" for e in ("left", "right"))


def _hit(k: str) -> str:
    return f"list_has_any({S.prop('left', k)}, {S.prop('right', k)})"


def _reasoning() -> str:
    low = lambda e: f"[lower(x) for x in {S.prop(e, 'name')}]"
    words = lambda e: f"[w for w in flatten([regexp_split_to_array(x, '{S.WS}+') for x in {low(e)}]) if w <> '']"
    ev = [f"CASE WHEN {_both('name')} THEN CASE WHEN list_has_any({low('left')}, {low('right')}) THEN 'names match' WHEN list_has_any({words('left')}, {words('right')}) THEN 'name tokens overlap' END END"]
    co = []
    for k, m, x in [
        ("birthDate", "birth dates match", None), ("country", "countries match", None), ("nationality", "nationalities match", None),
        ("idNumber", "idNumber matches", "different idNumber"), ("passportNumber", "passportNumber matches", "different passportNumber"),
        ("gender", "gender matches", "different genders"),
    ]:
        ev.append(f"CASE WHEN {_both(k)} AND {_hit(k)} THEN '{m}' END")
        if k == "birthDate":
            d = lambda e: f"coalesce(list_min({S.prop(e, 'birthDate')}), '')"
            co.append(f"CASE WHEN {_both(k)} AND NOT {_hit(k)} THEN 'different birth dates (' || {d('left')} || ' vs ' || {d('right')} || ')' END")
        elif x:
            co.append(f"CASE WHEN {_both(k)} AND NOT {_hit(k)} THEN '{x}' END")
    join = lambda xs: f"array_to_string([x for x in [{', '.join(xs)}] if x IS NOT NULL], ', ')"
    return f"""SELECT pair_id, CASE WHEN judgement = 'positive' THEN CASE WHEN e <> '' THEN 'Same entity. Evidence: ' || e || '. No contradictions found.' ELSE 'Same entity. Consistent attributes, no contradictions found.' END
      WHEN c <> '' THEN 'Different entities. Conflicts: ' || c || '.' ELSE 'Different entities. Insufficient matching evidence to confirm same person.' END AS reasoning
      FROM (SELECT pair_id, judgement, {join(ev)} AS e, {join(co)} AS c FROM pairs)"""


def _escaped(x: str) -> str:
    """A text as a JSON string with escapes beyond ASCII; letters above 16 bits by two."""
    u = "lpad(lower(to_hex({})), 4, '0')"
    two = f"'\\u' || {u.format('55296 + ((unicode(c) - 65536) >> 10)')} || '\\u' || {u.format('56320 + ((unicode(c) - 65536) & 1023)')}"
    one = f"CASE WHEN unicode(c) < 128 THEN c WHEN unicode(c) < 65536 THEN '\\u' || {u.format('unicode(c)')} ELSE {two} END"
    return f"array_to_string([{one} for c in string_split(to_json({x})::VARCHAR, '')], '')"


_USER = f"{_q(T.PAIR_HEAD)} || {_entity('left')} || {_q(T.PAIR_MIDDLE)} || {_entity('right')} || {_q(T.PAIR_SEARCH)}"
_ANSWER = f"""'{{"classification": ' || {_escaped("coalesce(judgement, '')")} || ', "confidence": "high", "reasoning": ' || {_escaped('reasoning')} || '}}'"""


def _record_sql(record: str) -> str:
    return f"SELECT pair_id, CAST(to_json({record}) AS VARCHAR) AS record FROM (SELECT pair_id, {_USER} AS user_text, {_ANSWER} AS answer FROM pairs JOIN ({_reasoning()}) USING (pair_id))"


def _turns(role: str, text: str, roles: tuple[str, str, str]) -> str:
    return "[" + ", ".join(f"{{'{role}': '{r}', '{text}': {v}}}" for r, v in zip(roles, (_q(T.SYSTEM), "user_text", "answer"), strict=True)) + "]"


SQL = {
    "sft_openai": _record_sql(f"{{'messages': {_turns('role', 'content', ('system', 'user', 'assistant'))}}}"),
    "sft_alpaca": _record_sql(f"{{'instruction': {_q(T.SYSTEM)}, 'input': user_text, 'output': answer}}"),
    "sft_sharegpt": _record_sql(f"{{'conversations': {_turns('from', 'value', ('system', 'human', 'gpt'))}}}"),
    "format_entity": f"SELECT pair_id, {_entity('left')} AS left_text, {_entity('right')} AS right_text FROM pairs",
    "format_entity_prompt": f"SELECT pair_id, {_prompt('left')} AS left_text FROM pairs",
    "format_entity_short": f"SELECT pair_id, {_prompt('right', 3)} AS right_text FROM pairs",
    "chat_messages": f"""SELECT pair_id, {_q('system: ' + T.SYSTEM)} || chr(10) || '---' || chr(10) || 'user: ' || {_q(T.PAIR_HEAD)} || {_prompt('left')} || {_q(T.PAIR_MIDDLE)} || {_prompt('right')}
      || {_q(T.PAIR_QUESTION)} || chr(10) || '---' || chr(10) || 'assistant: ' || coalesce(judgement, '') AS chat FROM pairs""",
    "reasoning_text": _reasoning(),
    "token_estimate": f"""SELECT CAST(sum(length({_q(T.PAIR_HEAD)} || {_entity('left')} || {_q(T.PAIR_MIDDLE)} || {_entity('right')} || {_q(T.PAIR_SEARCH)}) // 4) AS BIGINT) AS tokens FROM pairs""",
}
