"""Sources: pair files in four forms, labels, predictions, registries, chunks, and the columnar copy of the pairs."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom import schema as Z


def with_ordinal(df: DataFrame, name: str = "pair_id") -> DataFrame:
    """Numbers the rows in file order, dense from 0: files by name, rows by place. Done once at ingest, on a plain scan.

    A scan packs blocks of files into tasks by size, but reads each block in one task from start to end. So a row's place
    is that within its block and the number of rows in the blocks before; the table of blocks has a row for some 100 MB
    of input. No row is shuffled. A frame that comes from no file is numbered in the order of its partitions.
    """
    bits = 33  # the partition stands above these bits
    rows = df.withColumn("_m", F.monotonically_increasing_id())
    try:
        rows = rows.select("*", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"))
    except AnalysisException:
        rows = rows.withColumns({"_f": F.lit(""), "_b": F.shiftright("_m", bits)})
    blocks = rows.groupBy("_f", "_b").agg(F.count(F.lit(1)).alias("_n"), F.min("_m").alias("_first"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_f", "_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = rows.join(F.broadcast(blocks.select("_f", "_b", "_first", before.alias("_start"))), ["_f", "_b"])
    return placed.select((F.col("_m") - F.col("_first") + F.col("_start")).alias(name), *df.columns)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType = Z.RAW_PAIR, on_error: str = "fail") -> DataFrame:
    """JSON lines, plain or compressed; blank lines are skipped. ``on_error``: ``fail``, ``drop`` or ``keep``.

    ``keep`` adds ``_corrupt_record`` with the lines that can't be read.
    """
    mode = {"fail": "FAILFAST", "drop": "DROPMALFORMED", "keep": "PERMISSIVE"}[on_error]
    if on_error == "keep":
        schema = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    return spark.read.schema(schema).option("mode", mode).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def read_array(spark: SparkSession, path: str, schema: T.StructType = Z.RAW_PAIR) -> DataFrame:
    """One JSON array of records (the first form of samples)."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_sample(spark: SparkSession, path: str) -> DataFrame:
    """The second form, one document of metadata and pairs: ``pair_id`` is the position in it."""
    doc = T.StructType([T.StructField("metadata", Z.SAMPLE_METADATA), T.StructField("pairs", T.ArrayType(Z.RAW_PAIR))])
    d = spark.read.schema(doc).option("multiLine", True).json(path)
    return d.select(F.posexplode("pairs").alias("pair_id", "p")).select(F.col("pair_id").cast("long"), "p.*")


def sample_metadata(spark: SparkSession, path: str) -> DataFrame:
    """A sample's metadata, counts filled from its pairs where they are missing."""
    doc = T.StructType([T.StructField("metadata", Z.SAMPLE_METADATA), T.StructField("pairs", T.ArrayType(Z.RAW_PAIR))])
    d = spark.read.schema(doc).option("multiLine", True).json(path)
    n = lambda j: F.size(F.filter("pairs", lambda p: F.coalesce(p["judgement"] == j, F.lit(False)))).cast("long")
    return d.select("metadata.*", "pairs").withColumns({
        "n_positive": F.coalesce("n_positive", n("positive")), "n_negative": F.coalesce("n_negative", n("negative")),
        "n_total": F.coalesce("n_total", F.size("pairs").cast("long")),
    }).drop("pairs")


def sniff(spark: SparkSession, path: str) -> str:
    """``jsonl``, ``array`` or ``sample`` by how the file starts; only its first two lines are read."""
    head = [r.value for r in spark.read.text(path).where("trim(value) <> ''").limit(2).collect()]
    if not head or head[0].lstrip()[:1] == "[":
        return "array" if head else "jsonl"
    first = head[0].strip()
    alone = first == "{" or '"metadata"' in first[:40] or '"pairs"' in first[:40]
    return "sample" if alone else "jsonl"


def read_pairs(spark: SparkSession, path: str, format: str | None = None) -> DataFrame:
    """Pairs with their position, in any of the forms; parquet keeps the positions it has."""
    format = format or ("parquet" if path.rstrip("/").endswith(".parquet") else sniff(spark, path))
    if format == "parquet":
        return spark.read.parquet(path)
    if format == "sample":
        return read_sample(spark, path)
    return with_ordinal(read_array(spark, path) if format == "array" else read_jsonl(spark, path))


def head_rows(df: DataFrame, n: int, position: str = "pair_id") -> DataFrame:
    """The first n rows by position: a filter that reaches the scan, unlike a limit after a sort."""
    return df.where(F.col(position) < n)


def silver(pairs: DataFrame) -> DataFrame:
    """The pairs with hot properties of both sides as columns, ``left_name`` and so on."""
    get = lambda s, k: F.coalesce(F.try_element_at(F.col(f"{s}.properties"), F.lit(k)), F.array().cast("array<string>"))
    return pairs.withColumns({f"{s}_{k}": get(s, k) for s in ("left", "right") for k in Z.HOT_PROPERTIES})


def read_through(spark: SparkSession, source: str, cache: str, use_cache: bool = True) -> DataFrame:
    """The columnar copy of a raw file: read where it is there, else written from the file."""
    if not (use_cache and _exists(spark, f"{cache}/_SUCCESS")):
        silver(read_pairs(spark, source)).repartition(spark.sparkContext.defaultParallelism).write.mode("overwrite").parquet(cache)
    return spark.read.parquet(cache)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """``pair_id``, ``judgement`` from JSON lines or from a text file with a label per line."""
    if path.endswith((".txt", ".txt.gz")):
        lines = spark.read.text(path).select(F.trim("value").alias("judgement")).where("judgement <> ''")
        return with_ordinal(lines)
    return with_ordinal(read_jsonl(spark, path, T.StructType([T.StructField("judgement", T.StringType())])))


def align(truth: DataFrame, predicted: DataFrame, key: str = "pair_id") -> DataFrame:
    """Truth and prediction by position; another number of rows is an error."""
    a, b = truth.count(), predicted.count()
    if a != b:
        raise ValueError(f"{a} labels and {b} predictions")
    return truth.join(predicted, key)


def read_experiments(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, Z.EXPERIMENT)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)  # noqa: SLF001


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """The prompt registry's entries with their position; a registry that isn't there has none."""
    doc = T.StructType([T.StructField("prompts", T.ArrayType(Z.PROMPT))])
    d = spark.read.schema(doc).option("multiLine", True).json(path) if _exists(spark, path) else spark.createDataFrame([], doc)
    return d.select(F.posexplode("prompts").alias("position", "p")).select("position", "p.*")


def read_test_pairs(spark: SparkSession, path: str, raw: str, limit: int | None = None) -> DataFrame:
    """The JSON lines at ``path``, or the raw file where they are missing; the first ``limit`` by position, if given."""
    pairs = read_pairs(spark, path, "jsonl") if _exists(spark, path) else read_pairs(spark, raw)
    return pairs if limit is None else head_rows(pairs, limit)


def read_curated(spark: SparkSession, path: str, n: int | None = None) -> DataFrame:
    """Curated examples, a list or a document with ``examples``; the first n, if given. None where the file is missing."""
    if not _exists(spark, path):
        return spark.createDataFrame([], Z.PAIR)
    if sniff(spark, path) == "array":
        rows = with_ordinal(read_array(spark, path))
    else:
        doc = T.StructType([T.StructField("examples", T.ArrayType(Z.RAW_PAIR))])
        d = spark.read.schema(doc).option("multiLine", True).json(path)
        rows = d.select(F.posexplode("examples").alias("pair_id", "p")).select(F.col("pair_id").cast("long"), "p.*")
    return rows if n is None else head_rows(rows, n)


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """``name``, ``digest`` of a metadata document that maps files to checksums under ``checksums``."""
    doc = T.StructType([T.StructField("checksums", T.MapType(T.StringType(), T.StringType()))])
    d = spark.read.schema(doc).option("multiLine", True).json(path)
    return d.select(F.explode("checksums").alias("name", "digest"))


def read_chunks(spark: SparkSession, folder: str, n_chunks: int) -> tuple[DataFrame, list[int]]:
    """All chunk files of a folder, whichever key style their counts have, and the chunks that are missing."""
    counts = T.StructType([T.StructField(c, T.LongType()) for c in ("tp", "fp", "fn", "tn", "true_positive", "false_positive", "false_negative", "true_negative")])
    schema = T.StructType([T.StructField("chunk_id", T.LongType()), T.StructField("metrics", counts)])
    d = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "chunk_*.json").json(folder)
    both = {"true_positive": "tp", "false_positive": "fp", "false_negative": "fn", "true_negative": "tn"}
    rows = d.select("chunk_id", *[F.coalesce(f"metrics.{k}", f"metrics.{v}", F.lit(0)).alias(k) for k, v in both.items()])
    have = {r.chunk_id for r in rows.select("chunk_id").distinct().limit(n_chunks + 1).collect()}
    return rows, [i for i in range(n_chunks) if i not in have]


def read_published(spark: SparkSession, folder: str) -> DataFrame:
    """Published parquet, ``default/<split>/*.parquet``, with the split's name taken from the path."""
    d = spark.read.parquet(f"{folder}/default/*/*.parquet")
    return d.withColumn("split", F.regexp_extract(F.input_file_name(), r"/default/([^/]+)/", 1))


def read_demos(spark: SparkSession, path: str) -> DataFrame:
    """``predictor``, ``position``, ``demo`` from a compiled module, wherever its predictors nest them; empty demos are left out."""
    demo = T.StructType([T.StructField(c, T.StringType()) for c in ("entity_a", "entity_b", "reasoning", "classification")])
    schema = T.MapType(T.StringType(), T.StructType([T.StructField("demos", T.ArrayType(demo))]))
    text = spark.read.option("wholetext", True).text(path)
    d = text.select(F.explode(F.from_json("value", schema)).alias("predictor", "m"))
    d = d.select("predictor", F.posexplode("m.demos").alias("position", "demo"))
    return d.where(F.coalesce("demo.entity_a", "demo.entity_b", "demo.classification").isNotNull())
