"""Session defaults and the shared scratch tables that cut lineage.

Long plans are cut by writing a table below the folder named in ``spark.checkpoint.dir`` and reading it back. A written
table survives the loss of any executor, is compressed, is read column by column and tells the planner its size, which
a cached block does not.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def builder(app: str = "pairloom", master: str | None = None) -> SparkSession.Builder:
    """A builder with the settings the library is designed for; a cluster's own settings win over them."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    return b.master(master) if master else b


@cache
def _own_root() -> str:
    root = tempfile.mkdtemp(prefix="pairloom-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    return root


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; where that is unset, as in tests, a temporary folder of our own.

    The latter is for one machine only: on a cluster without the setting it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return (root or _own_root()).rstrip("/")


class Scratch:
    """Tables of one query below the shared folder. ``save`` writes and reads back, ``drop`` deletes early.

    What isn't dropped is deleted when the process ends, as the caller may run the returned plan at any time before.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{scratch_root(spark)}/pairloom-{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        atexit.register(self.clear)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        self._n += 1
        path = f"{self.base}/{self._n:03d}-{name}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path  # noqa: SLF001
        return out

    def drop(self, df: DataFrame) -> None:
        self._delete(df._scratch_path)  # noqa: SLF001

    def clear(self) -> None:
        try:
            self._delete(self.base)
        except Exception:  # noqa: BLE001 - the session may be gone at exit
            pass

    def _delete(self, path: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()  # noqa: SLF001
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Repartitions a scan whose files give fewer tasks than cores, before CPU-heavy Python; otherwise leaves it alone.

    A scan packs few small files into one task; the shuffle costs far less than idle cores when every row is then worked
    on in Python. A frame that already shuffles is left to the adaptive planner, as asking for its partitions would run it.
    """
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():  # noqa: SLF001
        return df
    have, cores = df.rdd.getNumPartitions(), df.sparkSession.sparkContext.defaultParallelism
    return df if have >= cores else df.repartition(cores * 2)
