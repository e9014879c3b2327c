"""Sinks: JSON lines, sample documents, training files, registries, reports."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from pairloom.functions.render import training_record


def write_jsonl(df: DataFrame, path: str, record: Column | None = None) -> int:
    """One JSON record per line; gives the number of rows, observed while they are written."""
    seen = Observation()
    text = F.to_json(record if record is not None else F.struct(*df.columns))
    df.select(text.alias("value")).observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").text(path)
    return seen.get["n"]


def write_sample(pairs: DataFrame, path: str, metadata: dict) -> None:
    """A sample document of metadata and pairs in order of position, for samples that fit one file.

    One task writes it, line by line, in the shared file system; nothing comes to the driver.
    """
    spark = pairs.sparkSession
    head = json.dumps({"metadata": metadata}, ensure_ascii=False)[:-1] + ', "pairs": ['
    rows = pairs.select(F.col("pair_id").alias("at"), F.to_json(F.struct(*[c for c in pairs.columns if c != "pair_id"])).alias("value"))
    least = pairs.agg(F.min("pair_id")).first()[0]
    rows = rows.select("at", F.concat(F.when(F.col("at") == F.lit(least), "").otherwise(","), "value").alias("value"))
    ends = spark.createDataFrame([(-1, head), (2**62, "]}")], "at long, value string")
    rows.unionByName(ends).repartition(1).sortWithinPartitions("at").select("value").write.mode("overwrite").text(path)


def write_chunks(counts: DataFrame, path: str) -> None:
    """One document for each row of counts, ``chunk_id`` and its ``metrics``, named as the reader of chunks expects."""
    spark = counts.sparkSession
    fs = spark._jvm.org.apache.hadoop.fs  # noqa: SLF001
    folder = fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())  # noqa: SLF001
    rest = [c for c in counts.columns if c != "chunk_id"]
    rows = counts.select("chunk_id", F.struct(*rest).alias("metrics"), F.col("chunk_id").alias("folder"))
    rows.write.mode("overwrite").partitionBy("folder").json(f"{path}/parts")
    # a rename for each file, of which there are as many as chunks
    for part in system.globStatus(fs.Path(f"{path}/parts/folder=*/*.json")):
        chunk = part.getPath().getParent().getName().split("=")[1]
        system.rename(part.getPath(), fs.Path(f"{path}/chunk_{int(chunk):02d}.json"))
    system.delete(fs.Path(f"{path}/parts"), True)


def write_training(pairs: DataFrame, path: str, kinds: tuple[str, ...] = ("openai", "alpaca", "sharegpt")) -> None:
    """All training formats of all splits (column ``split``) in one pass over the pairs, a folder for each."""
    records = F.array(*[F.struct(F.lit(k).alias("format"), F.to_json(training_record(k)).alias("value")) for k in kinds])
    rows = pairs.select("split", F.explode(records).alias("r")).select("split", "r.format", "r.value")
    rows.write.mode("overwrite").partitionBy("split", "format").text(path)


def write_results(results: DataFrame, path: str) -> None:
    """Prediction rows in order of their pair."""
    results.orderBy("pair_index").write.mode("overwrite").json(path)


def document(df: DataFrame, name: str) -> DataFrame:
    """A result of bounded size as one JSON document of one row."""
    return df.agg(F.to_json(F.struct(F.array_sort(F.collect_list(F.struct(*df.columns))).alias(name))).alias("value"))


def markdown(df: DataFrame, n: int = 100) -> str:
    """The first n rows as a Markdown table; doubles as percentages."""
    kinds = dict(df.dtypes)
    shown = [F.format_string("%.2f%%", F.col(c) * 100).alias(c) if kinds[c] == "double" else F.col(c).cast("string") for c in df.columns]
    rows = df.select(*shown).limit(n).collect()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else v for v in r) + " |" for r in rows])


def patch_document(doc: dict, drop: list[str], defaults: dict, values: dict) -> dict:
    """A metadata document without some keys, with defaults for missing ones and values that replace."""
    out = {k: v for k, v in doc.items() if k not in drop}
    return {**defaults, **out, **values}
