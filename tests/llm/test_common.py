"""Shared helpers of the corpus operators."""

import os
import subprocess
import sys
import time

import pytest
from pyspark.sql import functions as F

from millrace.llm.common import shared_dir, spread, word_count


def test_spread_touches_one_small_file_alone(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"text {k}") for k in range(50)], "doc_id long, text string")
    rows.coalesce(1).write.parquet(f"{tmp_path}/one")
    rows.repartition(2).write.parquet(f"{tmp_path}/two")
    read = lambda n: spark.read.parquet(f"{tmp_path}/{n}")
    exchanged = lambda df: "Exchange" in df._jdf.queryExecution().executedPlan().toString()
    assert exchanged(spread(read("one"))) and not exchanged(spread(read("two"))) and not exchanged(spread(read("one"), small=1))
    assert not exchanged(spread(rows))
    assert sorted(spread(read("one")).collect()) == sorted(rows.collect())
    assert spread(rows.limit(0)).count() == 0


def test_words_are_parted_by_ascii_space_alone(spark):
    texts = [None, "", " \t\n", "a", " a  b\x0bc\x0cd\r", "a b c", "é ß"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(word_count(F.col("t")).alias("n")).collect()
    assert [r.n for r in got] == [0, 0, 0, 1, 4, 2, 2]


def test_a_cluster_without_a_shared_folder_is_refused():
    from types import SimpleNamespace

    conf = SimpleNamespace(get=lambda key, default=None: default)
    for master in ("local-cluster[2,1,1024]", "spark://host:7077", "yarn"):
        session = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(getConf=lambda: conf, master=master))
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            shared_dir(session)


def test_stored_files_go_with_the_application(tmp_path):
    code = f"""
from millrace.session import session
spark = session(master="local[1]", partitions=1, **{{"spark.checkpoint.dir": "file://{tmp_path}"}})
from millrace.llm.common import stored
assert stored(spark.range(3), "x").count() == 3
"""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120, capture_output=True)
    for _ in range(50):
        if not [p for p in os.listdir(tmp_path) if p.startswith("x-")]:
            return
        time.sleep(0.2)
    raise AssertionError(os.listdir(tmp_path))
