import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]

SCRIPT = """
from pyspark.sql import SparkSession
from sieveline.llm.common import checkpointed, shared_dir, written
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
frame = spark.range(5)
assert checkpointed(frame).count() == written(frame, "x").count() == 5
assert shared_dir(spark) == shared_dir(spark)
"""


def test_a_folder_is_found_where_none_is_set(tmp_path):
    env = {**os.environ, "SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": str(ROOT)}
    done = subprocess.run([sys.executable, "-c", SCRIPT], env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-1500:]


def test_other_masters_need_a_shared_folder():
    from types import SimpleNamespace as Made

    import pytest

    from sieveline.llm.common import shared_dir

    unset = Made(getCheckpointDir=lambda: Made(isEmpty=lambda: True))
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]", "k8s://x"):
        session = Made(sparkContext=Made(master=master, _jsc=Made(sc=lambda: unset)), conf=Made(get=lambda *_: None))
        with pytest.raises(RuntimeError, match="checkpoint.dir"):
            shared_dir(session)


def test_settings_come_back_and_tables_go(spark):
    from pathlib import Path

    from sieveline.llm.common import intermediates, settled, shared_dir, written

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    with intermediates(spark):
        path = Path(written(spark.range(5), "gone").inputFiles()[0].removeprefix("file://")).parent
        assert path.exists()
    assert not path.exists() and spark.conf.get(key) == before
    kept = settled(spark, lambda: written(spark.range(7), "between"), "whole")
    assert kept.count() == 7
    assert not list(Path(shared_dir(spark).removeprefix("file://")).glob("sieveline/between-*"))


def test_the_set_folder_is_used(spark):
    from sieveline.llm.common import shared_dir, shared_path

    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert shared_path(spark, "y").startswith(spark.conf.get("spark.checkpoint.dir"))


def test_joins_with_and_without_broadcast(spark):
    from pyspark.sql import functions as F

    from sieveline.llm.common import join_spread

    many = spark.range(1000).select("id", (F.col("id") % 3).alias("k"))
    few = spark.createDataFrame([(0, "a"), (1, "b")], "k long, v string")
    want = {(i, i % 3, {0: "a", 1: "b"}.get(i % 3)) for i in range(1000)}
    for rows in (None, 0):
        assert {(r.id, r.k, r.v) for r in join_spread(many, few, "k", ["id"], rows).collect()} == want
