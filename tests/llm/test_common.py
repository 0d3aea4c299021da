import os
import subprocess
import sys
from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

import geoloom
from geoloom.llm import common, url_filter

ROOT = Path(geoloom.__file__).parents[1]

ELSEWHERE = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
from geoloom.llm import simhash
docs = spark.createDataFrame([(1, "a b c d"), (2, "A b c d"), (3, None)], "doc_id long, text string")
print("groups", sorted((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()))
"""


def test_executors_get_the_package_wherever_the_driver_runs(tmp_path):
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "SPARK_HOME")}
    done = subprocess.run([sys.executable, "-c", ELSEWHERE.format(root=str(ROOT))], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=200)
    assert "groups [(1, 1), (2, 1), (3, 3)]" in done.stdout, done.stderr[-2000:]


def test_tables_go_to_the_shared_folder(spark):
    df = common.materialize(spark.range(5), "numbers")
    assert df.count() == 5 and df.inputFiles()[0].startswith("file:/")
    assert common.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


def test_groups_hold_whole_texts(spark):
    import pyarrow as pa

    texts = pa.array(["x" * (3 << 20), "y" * (3 << 20), None, "z" * (9 << 20), ""])
    found = list(common.groups(texts))
    assert sum(n for _, n in found) == 5 and [at for at, _ in found] == [sum(n for _, n in found[:k]) for k in range(len(found))]
    assert list(common.groups(pa.array([], pa.string()))) == []


def test_url_parts(spark):
    rows = spark.createDataFrame([("HTTP://A.B/c?d",), (None,)], "u string").select(url_filter.host_of(F.col("u")), url_filter.path_of(F.col("u")))
    assert [tuple(r) for r in rows.collect()] == [("a.b", "/c"), ("", "")]


def test_rows_picked_by_hash(spark):
    rows = spark.range(100_000)
    assert 400 < rows.where(common.picked_by_hash("a", "id", share=0.005)).count() < 600
    assert rows.where(common.picked_by_hash("a", "id", share=1.0)).count() == 100_000
    assert rows.where(common.picked_by_hash("a", "id", share=F.lit(0.0))).isEmpty()


def test_tables_can_be_removed(spark):
    common.remove_tables(spark)
    paths = [common.materialize(spark.range(5), "numbers").inputFiles()[0].removeprefix("file://") for _ in range(3)]
    common.remove_tables(spark, since=1, keep=1)
    assert list(map(os.path.exists, paths)) == [True, False, True] and common.written() == 2
    common.remove_tables(spark)
    assert not any(map(os.path.exists, paths)) and common.written() == 0


def test_a_cluster_needs_a_shared_folder():
    context = SimpleNamespace(master="spark://somewhere:7077")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(SimpleNamespace(conf={}, sparkContext=context))


def test_files_reach_the_tasks(spark, tmp_path):
    (tmp_path / "words.txt").write_text("plum")
    file = common.ship_file(spark, str(tmp_path / "words.txt"))
    assert common.ship_file(spark, str(tmp_path / "words.txt")) == file

    def start():
        with open(file.path()) as f:
            word = f.read()
        return lambda texts: {"n": [t.count(word) for t in texts]}

    docs = spark.createDataFrame([(1, "a plum"), (2, None)], "doc_id long, text string")
    assert sorted(map(tuple, common.map_rows(docs, start, ["doc_id"], "text", "n long").collect())) == [(1, 1), (2, 0)]
