"""Small pair tables for tests: entities are given by keyword, everything else is null."""

from pyspark.sql import types as T

ENTITY = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("caption", T.StringType()),
        T.StructField("schema", T.StringType()),
        T.StructField("datasets", T.ArrayType(T.StringType())),
        T.StructField("first_seen", T.StringType()),
        T.StructField("last_seen", T.StringType()),
        T.StructField("properties", T.MapType(T.StringType(), T.ArrayType(T.StringType()))),
    ]
)
PAIR = T.StructType(
    [
        T.StructField("pair_id", T.LongType()),
        T.StructField("left", ENTITY),
        T.StructField("right", ENTITY),
        T.StructField("judgement", T.StringType()),
    ]
)


def ent(id=None, caption=None, schema="Person", datasets=None, first_seen=None, last_seen=None, **props):
    values = {k: v if isinstance(v, list) or v is None else [v] for k, v in props.items()}
    return (id, caption, schema, datasets, first_seen, last_seen, values)


def pairs(spark, rows):
    """rows: (left, right, judgement), the pair ids count from 0."""
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], PAIR)
