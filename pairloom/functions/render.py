"""Entities and pairs as text: field lists, prompts, messages, training records, rule-based reasoning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairloom.functions.text import prop

# Property, label, most values shown, separator.
FIELDS = [
    ("name", "Names", 8, ", "), ("alias", "Aliases", 4, ", "), ("birthDate", "Birth Date", None, ", "), ("birthPlace", "Birth Place", 2, ", "),
    ("nationality", "Nationality", None, ", "), ("country", "Country", None, ", "), ("address", "Address", 3, "; "),
    ("idNumber", "ID Numbers", 3, ", "), ("passportNumber", "Passport", 2, ", "), ("gender", "Gender", None, ", "),
    ("position", "Position", 2, ", "), ("firstName", "First Name", None, ", "), ("lastName", "Last Name", None, ", "),
]
# The frame of a pair's prompt.
PAIR_HEAD, PAIR_MIDDLE = "Compare these two entities:\n\n=== ENTITY A ===\n", "\n\n=== ENTITY B ===\n"
PAIR_QUESTION = "\n\nAre these the same entity?"
PAIR_SEARCH = "\n\nSearch for CONTRADICTIONS. If none found, classify as POSITIVE."
#: A system text of our own; callers pass theirs.
SYSTEM = "Decide whether two records denote the same person or organisation. Answer positive or negative."


def _lines(entity: str, fields: list[Column]) -> Column:
    head = F.concat(F.lit("Type: "), F.coalesce(F.col(f"{entity}.schema"), F.lit("Unknown")))
    return F.concat(F.array(head), F.array_compact(F.array(*fields)))


def format_entity(entity: str) -> Column:
    """A line per property that is there, empty ones included; only the first values where a limit is set."""
    out = []
    for key, label, limit, sep in FIELDS:
        v = F.try_element_at(F.col(f"{entity}.properties"), F.lit(key))
        there = F.coalesce(F.map_contains_key(f"{entity}.properties", key), F.lit(False))
        shown = F.slice(v, 1, limit) if limit else v
        out.append(F.when(there, F.concat(F.lit(f"{label}: "), F.coalesce(F.array_join(shown, sep), F.lit("")))))
    return F.array_join(_lines(entity, out), "\n")


def format_entity_for_prompt(entity: str, max_fields: int = 10) -> Column:
    """A line per property with content, without the address, at most ``max_fields``; blanks go after the limit is applied."""
    out = []
    for key, label, limit, _ in FIELDS:
        if key != "address":
            v = prop(entity, key)
            text = F.array_join(F.filter(F.slice(v, 1, limit) if limit else v, lambda x: x != ""), ", ")
            out.append(F.when(text != "", F.concat(F.lit(f"{label}: "), text)))
    return F.array_join(F.slice(_lines(entity, out), 1, max_fields + 1), "\n")


def pair_prompt(left: Column, right: Column, question: str = PAIR_QUESTION) -> Column:
    return F.concat(F.lit(PAIR_HEAD), left, F.lit(PAIR_MIDDLE), right, F.lit(question))


def messages(*turns: tuple[str, Column]) -> Column:
    """An array of role and content."""
    return F.array(*[F.struct(F.lit(r).alias("role"), c.alias("content")) for r, c in turns])


def with_suffix_on_last_user(msgs: Column, suffix: str) -> Column:
    """The messages with a text appended to the last one of the user."""
    last = F.array_max(F.transform(msgs, lambda m, i: F.when(m["role"] == "user", i)))
    return F.transform(msgs, lambda m, i: F.struct(m["role"].alias("role"), F.when(i == last, F.concat(m["content"], F.lit(suffix))).otherwise(m["content"]).alias("content")))


def few_shot_block(examples: Column) -> Column:
    """Numbered examples of ``text`` and ``label``."""
    line = lambda x, i: F.concat(F.lit("Example "), (i + 1).cast("string"), F.lit(":\n"), x["text"], F.lit("\nAnswer: "), x["label"])
    return F.array_join(F.transform(examples, line), "\n\n")


# The wording of examples in prompts, by the three forms in use.
NUMBERED = {
    "head": "Here are some examples:\n\n", "example": "Example {}:\n=== ENTITY A ===\n{}\n\n=== ENTITY B ===\n{}\n\nClassification: {}\nReasoning: {}\n---",
    "between": "\n", "foot": "\n\nNow classify this pair:\n\n",
}
TITLED = {
    "head": "Here are some examples of entity matching decisions:\n\n", "example": "=== EXAMPLE ===\nENTITY A:\n{}\n\nENTITY B:\n{}\n\nCLASSIFICATION: {}\nREASONING: {}",
    "between": "\n\n", "foot": "\n\n=== NOW CLASSIFY THIS PAIR ===\n\n",
}
TITLED_REASONS = {
    "positive": "Names are consistent (may be variations/transliterations), no contradictory evidence found. Default to positive when no conflicts exist.",
    "negative": "Conflicting evidence found (different dates, identifiers, or other attributes) indicates different entities.",
}
NO_REASON = "Based on available evidence."
ANSWER_ONLY = '\nRespond with only "positive" or "negative".'


def filled(template: str, *values: Column) -> Column:
    """A template's text with its places filled in turn; null is the empty text."""
    parts = template.split("{}")
    out = [F.lit(parts[0])]
    for v, text in zip(values, parts[1:], strict=True):
        out += [F.coalesce(v.cast("string"), F.lit("")), F.lit(text)]
    return F.concat(*out)


def numbered_examples(examples: Column) -> Column:
    """Examples of ``a``, ``b``, ``label``, ``reasoning``, numbered from 1, up to where the pair asked for follows; empty for none."""
    one = lambda x, i: filled(NUMBERED["example"], i + 1, x["a"], x["b"], x["label"], F.coalesce(x["reasoning"], F.lit(NO_REASON)))
    block = F.concat(F.lit(NUMBERED["head"]), F.array_join(F.transform(examples, one), NUMBERED["between"]), F.lit(NUMBERED["foot"]))
    return F.when(F.size(examples) > 0, block).otherwise(F.lit(""))


def titled_examples(examples: Column) -> Column:
    """Examples of ``a``, ``b``, ``label`` under titles, each with the standing reason of its label."""
    reason = lambda x: F.when(x["label"] == "positive", TITLED_REASONS["positive"]).otherwise(TITLED_REASONS["negative"])
    one = lambda x: filled(TITLED["example"], x["a"], x["b"], x["label"], reason(x))
    return F.concat(F.lit(TITLED["head"]), F.array_join(F.transform(examples, one), TITLED["between"]), F.lit(TITLED["foot"]))


def request(user: Column, system: str = SYSTEM, responses_api: bool = False) -> Column:
    """The two messages of a request; the responses interface calls the first role developer."""
    return messages(("developer" if responses_api else "system", F.lit(system)), ("user", user))


# The wording of short reasons: property, text where both sides share a value or don't.
SHORT_MATCHES = [("name", "names match or are variations"), ("birthDate", "birth dates match"), ("nationality", "nationalities match")]
SHORT_CONFLICTS = [("birthDate", "different birth dates"), ("nationality", "different nationalities"), ("gender", "different genders")]
SHORT_POSITIVE = "No contradictions found. {}. Same entity.", "No contradictory evidence found. Default to POSITIVE."
SHORT_NEGATIVE = "Contradictions found: {}. Different entities.", "Explicit conflicts in identifying attributes. Different entities."


def short_reasoning() -> Column:
    """The short reason of a pair's judgement, from properties that both sides have values of; names needn't be equal."""
    shared = lambda k: F.coalesce(F.arrays_overlap(prop("left", k), prop("right", k)), F.lit(False))
    both = lambda k: (F.size(prop("left", k)) > 0) & (F.size(prop("right", k)) > 0)
    joined = lambda xs: F.array_join(F.array_compact(F.array(*xs)), ", ")
    yes = joined([F.when(both(k) & (F.lit(k == "name") | shared(k)), text) for k, text in SHORT_MATCHES])
    no = joined([F.when(both(k) & ~shared(k), text) for k, text in SHORT_CONFLICTS])
    capital = F.concat(F.upper(F.substring(yes, 1, 1)), F.substring(yes, F.lit(2), F.length(yes)))
    positive = F.when(yes != "", filled(SHORT_POSITIVE[0], capital)).otherwise(SHORT_POSITIVE[1])
    negative = F.when(no != "", filled(SHORT_NEGATIVE[0], no)).otherwise(SHORT_NEGATIVE[1])
    return F.when(F.col("judgement") == "positive", positive).otherwise(negative)


def _overlap(key: str) -> tuple[Column, Column]:
    l, r = prop("left", key), prop("right", key)
    has = lambda e: F.coalesce(F.map_contains_key(f"{e}.properties", key), F.lit(False))
    return has("left") & has("right"), F.coalesce(F.arrays_overlap(l, r), F.lit(False))


def reasoning() -> Column:
    """Evidence of a positive pair or conflicts of another, found by rules on the properties that both sides have.

    Where several birth dates differ, the smallest of each side is named.
    """
    low = lambda e: F.transform(prop(e, "name"), F.lower)
    words = lambda e: F.filter(F.flatten(F.transform(low(e), lambda n: F.split(n, r"(?U)\s+"))), lambda w: w != "")
    both_names, _ = _overlap("name")
    same = F.coalesce(F.arrays_overlap(low("left"), low("right")), F.lit(False))
    share = F.coalesce(F.arrays_overlap(words("left"), words("right")), F.lit(False))
    evidence = [F.when(both_names, F.when(same, "names match").when(share, "name tokens overlap"))]
    conflicts = []
    told = [("birthDate", "birth dates match", None), ("country", "countries match", None), ("nationality", "nationalities match", None)]
    told += [(k, f"{k} matches", f"different {k}") for k in ("idNumber", "passportNumber")] + [("gender", "gender matches", "different genders")]
    for key, match, differ in told:
        both, hit = _overlap(key)
        evidence.append(F.when(both & hit, match))
        if key == "birthDate":
            d = lambda e: F.coalesce(F.array_min(prop(e, "birthDate")), F.lit(""))
            conflicts.append(F.when(both & ~hit, F.concat(F.lit("different birth dates ("), d("left"), F.lit(" vs "), d("right"), F.lit(")"))))
        elif differ:
            conflicts.append(F.when(both & ~hit, differ))
    e, c = (F.array_join(F.array_compact(F.array(*x)), ", ") for x in (evidence, conflicts))
    yes = F.when(e != "", F.concat(F.lit("Same entity. Evidence: "), e, F.lit(". No contradictions found."))).otherwise("Same entity. Consistent attributes, no contradictions found.")
    no = F.when(c != "", F.concat(F.lit("Different entities. Conflicts: "), c, F.lit("."))).otherwise("Different entities. Insufficient matching evidence to confirm same person.")
    return F.when(F.col("judgement") == "positive", yes).otherwise(no)


def json_text(c: Column) -> Column:
    """A text as a JSON string with its quotes, letters beyond ASCII escaped."""
    a = F.to_json(F.array(c))
    plain = F.substring(a, F.lit(2), F.length(a) - 2)
    units = lambda x: F.regexp_replace(F.lower(F.hex(F.encode(x, "UTF-16BE"))), "(.{4})", r"\\u$1")
    escaped = F.array_join(F.transform(F.split(plain, ""), lambda x: F.when(F.octet_length(x) > 1, units(x)).otherwise(x)), "")
    return F.when(F.octet_length(plain) == F.char_length(plain), plain).otherwise(escaped)


def response() -> Column:
    """The answer of a training record as JSON, blanks after commas and colons, letters beyond ASCII escaped."""
    part = lambda k, v: F.concat(F.lit(f'"{k}": '), json_text(v))
    fields = [part("classification", F.coalesce("judgement", F.lit(""))), part("confidence", F.lit("high")), part("reasoning", reasoning())]
    return F.concat(F.lit("{"), F.concat_ws(", ", *fields), F.lit("}"))


def training_record(kind: str, system: str = SYSTEM) -> Column:
    """A pair as ``openai`` messages, ``alpaca`` fields or ``sharegpt`` conversations."""
    user = pair_prompt(format_entity("left"), format_entity("right"), PAIR_SEARCH)
    if kind == "openai":
        return F.struct(messages(("system", F.lit(system)), ("user", user), ("assistant", response())).alias("messages"))
    if kind == "alpaca":
        return F.struct(F.lit(system).alias("instruction"), user.alias("input"), response().alias("output"))
    if kind == "sharegpt":
        turns = [("system", F.lit(system)), ("human", user), ("gpt", response())]
        return F.struct(F.array(*[F.struct(F.lit(f).alias("from"), v.alias("value")) for f, v in turns]).alias("conversations"))
    raise ValueError(f"no such training format: {kind}")
