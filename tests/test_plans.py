"""Plans: what reaches the scan, which joins are chosen, and that nothing leaves the JVM."""

import re

import pytest

from geoloom import workload

#: Queries that ask a service or fetch texts, or judge the JSON of queries, and so run Python.
PYTHON = {"resolve_service", "remote_table", "query_checks"}


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.mark.parametrize("name", sorted(set(workload.QUERIES) - PYTHON))
def test_no_python_and_no_cross_joins(spark, sf_dir, name):
    text = plan(workload.QUERIES[name](spark, sf_dir))
    assert not re.search("EvalPython|InPandas|InArrow|CartesianProduct|BroadcastNestedLoopJoin", text)


@pytest.mark.parametrize(
    ("name", "pushed", "columns"),
    [
        ("occ_points", "GreaterThan(l_extendedprice,1000.0)", {"l_partkey", "l_extendedprice", "l_quantity"}),
        ("bbox_open", "LessThan(l_discount,0.05)", {"l_orderkey", "l_linenumber", "l_quantity", "l_discount"}),
        ("unit_join", "EqualTo(o_custkey,7)", {"o_orderkey", "o_custkey"}),
    ],
)
def test_filters_and_columns_reach_the_scan(spark, sf_dir, name, pushed, columns):
    text = plan(workload.QUERIES[name](spark, sf_dir))
    scans = [s for s in text.split("\n\n") if "ReadSchema" in s and pushed in s]
    assert scans, text
    assert set(re.findall(r"(\w+):", scans[0].split("ReadSchema: ")[1])) - {"struct"} == columns


@pytest.mark.parametrize("name", ["occ_points", "taxa_names", "provenance_occ", "source_counts"])
def test_taxa_are_semi_joins(spark, sf_dir, name):
    assert "LeftSemi" in plan(workload.QUERIES[name](spark, sf_dir))


@pytest.mark.parametrize("name", ["occ_points", "occ_attributes", "unit_join", "archive_points"])
def test_few_keys_go_to_every_executor(spark, sf_dir, name):
    text = plan(workload.QUERIES[name](spark, sf_dir))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


def test_many_keys_are_shuffled(spark, sf_dir, monkeypatch):
    from geoloom.sources import tables

    def count(most):
        monkeypatch.setattr(tables.small, "__defaults__", (most,))
        found = workload.QUERIES["occ_points"](spark, sf_dir)
        return found.count(), "SortMergeJoin" in plan(found) or "ShuffledHashJoin" in plan(found)

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        few, many = count(tables.BROADCAST_ROWS), count(0)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert few[0] == many[0] and (few[1], many[1]) == (False, True)
