"""Pieces of DuckDB SQL that the queries' SQL forms share."""

WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def norm(x: str) -> str:
    return f"lower(regexp_replace(coalesce({x}, ''), '^{WS}+|{WS}+$', '', 'g'))"


def token_key(x: str) -> str:
    return f"array_to_string(list_sort([w for w in regexp_split_to_array({norm(x)}, '{WS}+') if w <> '']), ' ')"


def prop(e: str, k: str) -> str:
    return f"coalesce(\"{e}\".properties['{k}'], [])"


def positive(x: str) -> str:
    return f"coalesce({norm(x)} = 'positive', false)"


SIDES = """sides AS (
  SELECT pair_id, 0 AS side, "left" AS e FROM pairs UNION ALL SELECT pair_id, 1, "right" FROM pairs)"""
FIRST = SIDES + """, firsts AS (
  SELECT e.id AS id, arg_min(e, pair_id * 2 + side) AS e FROM sides WHERE e.id <> '' GROUP BY e.id)"""

METRICS = """
  CASE WHEN tp+fp+fn+tn = 0 THEN 0.0 ELSE (tp+tn)::DOUBLE/(tp+fp+fn+tn) END AS accuracy,
  CASE WHEN tp+fp = 0 THEN 0.0 ELSE tp::DOUBLE/(tp+fp) END AS precision, CASE WHEN tp+fn = 0 THEN 0.0 ELSE tp::DOUBLE/(tp+fn) END AS recall,
  CASE WHEN tn+fn = 0 THEN 0.0 ELSE tn::DOUBLE/(tn+fn) END AS negative_precision,
  CASE WHEN tn+fp = 0 THEN 0.0 ELSE tn::DOUBLE/(tn+fp) END AS negative_recall"""


def with_f1(inner: str, keep: str) -> str:
    """Counts tp, fp, fn, tn of a query to the full row of metrics; keep: its other columns."""
    f = lambda p, r: f"CASE WHEN {p}+{r} = 0 THEN 0.0 ELSE 2.0::DOUBLE*({p}*{r})/({p}+{r}) END"
    k = f"{keep}, " if keep else ""
    return f"""SELECT {k}tp AS true_positive, fp AS false_positive, fn AS false_negative, tn AS true_negative, accuracy, precision, recall,
  negative_precision, negative_recall, {f('precision', 'recall')} AS f1, {f('negative_precision', 'negative_recall')} AS negative_f1
FROM (SELECT {k}tp, fp, fn, tn, {METRICS} FROM ({inner}))"""


def cells(truth: str, predicted: str) -> str:
    t, p = f"coalesce({truth} = 'positive', false)", f"coalesce({predicted} = 'positive', false)"
    one = lambda c: f"CAST(count(*) FILTER ({c}) AS BIGINT)"
    return f"{one(f'{t} AND {p}')} AS tp, {one(f'NOT {t} AND {p}')} AS fp, {one(f'{t} AND NOT {p}')} AS fn, {one(f'NOT {t} AND NOT {p}')} AS tn"
