from types import SimpleNamespace

import pytest

from pairloom.session import Scratch, scratch_root


def fake(root, master):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: root), sparkContext=SimpleNamespace(master=master))


def test_scratch_root():
    assert scratch_root(fake("hdfs://x/y/", "spark://h")) == "hdfs://x/y"
    assert scratch_root(fake(None, "local[2]")) == scratch_root(fake("", "local[2]"))
    with pytest.raises(RuntimeError):
        scratch_root(fake(None, "spark://h"))


def test_saved_tables_are_read_back_and_dropped(spark):
    s = Scratch(spark, "t")
    df = s.save(spark.range(5), "a")
    assert df.count() == 5 and "parquet" in df._jdf.queryExecution().toString().lower()
    s.drop(df)
    s.clear()
    with pytest.raises(Exception):
        spark.read.parquet(df._scratch_path).count()
