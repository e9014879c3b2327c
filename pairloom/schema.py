"""Schemas of the records that sources read. Property keys are open, so properties are a map, never an inferred struct."""

from pyspark.sql import types as T

_S, _L, _D = T.StringType(), T.LongType(), T.DoubleType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k.rstrip("_"), v) for k, v in fields.items()])


ENTITY = _struct(
    id=_S, caption=_S, schema=_S, datasets=T.ArrayType(_S), first_seen=_S, last_seen=_S, properties=T.MapType(_S, T.ArrayType(_S))
)
RAW_PAIR = _struct(left=ENTITY, right=ENTITY, judgement=_S)
PAIR = T.StructType([T.StructField("pair_id", _L), *RAW_PAIR.fields])
SAMPLE_METADATA = _struct(
    seed=_L, n_total=_L, n_positive=_L, n_negative=_L, positive_ratio=_D, target_ratio=_D, source=_S, created=_S,
    stratified=T.BooleanType(), shuffled=T.BooleanType(),
)
CONFUSION = _struct(true_negative=_L, false_positive=_L, false_negative=_L, true_positive=_L)
METRICS = _struct(accuracy=_D, precision=_D, recall=_D, f1=_D, confusion_matrix=CONFUSION)
EXPERIMENT = _struct(
    run_id=_S, timestamp=_S, method=_S, input_file=_S, git=_struct(commit=_S, branch=_S), params=T.MapType(_S, _S), metrics=METRICS, notes=_S
)
PROMPT = _struct(
    prompt_id=_S, model=_S, description=_S, path=_S, is_default=T.BooleanType(), created_date=_S,
    provenance=_struct(optimizer=_S, dev_f1=_D, source=_S, notes=_S),
)
PREDICTION = _struct(
    classification=_S, confidence=_S, reasoning=_S, tokens_used=_struct(prompt=_L, completion=_L, total=_L), ground_truth=_S, pair_index=_L, error=_S
)
#: Properties that queries touch most; ``silver`` keeps them as columns of their own, as a map can't be pruned.
HOT_PROPERTIES = ["name", "alias", "weakAlias", "birthDate", "country", "nationality", "address", "idNumber"]
