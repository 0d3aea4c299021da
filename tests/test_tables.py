"""Tables from a database, shared folders, counted broadcasts and repeatable samples."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from geoloom.operators import taxa, terminology
from geoloom.sources import archive, tables, tabular
from tests.test_plans import plan

DRIVER = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}


def test_tables_of_a_database(spark):
    url = "jdbc:derby:memory:geoloom;create=true"
    rows = spark.createDataFrame([(1, "Felis catus", "genus"), (2, "Felix", "genus"), (3, "Canis", "family")], "taxon long, term string, level string")
    rows.write.format("jdbc").options(url=url, dbtable="taxon_to_term", createTableColumnTypes="term VARCHAR(64), level VARCHAR(64)", **DRIVER).mode("overwrite").save()
    found = tables.from_database(spark, url, {"taxon_to_term": "taxon_to_term"}, DRIVER)["taxon_to_term"]
    assert sorted(tuple(r) for r in found.collect()) == sorted(tuple(r) for r in rows.collect())
    assert {r[0] for r in taxa.resolve_taxa(found, "fel", "genus").collect()} == {1, 2}
    assert "PushedFilters: [*IsNotNull(level), *EqualTo(level,genus)]" in plan(found.where("level = 'genus'")).replace("LEVEL", "level").replace('"', "")


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        tables.shared_folder(SimpleNamespace(conf={}, sparkContext=SimpleNamespace(master="yarn")))


def test_few_rows_are_counted(spark):
    rows = spark.range(10)
    assert "broadcast" in tables.small(rows, 10)._jdf.queryExecution().toString() and "broadcast" not in tables.small(rows, 9)._jdf.queryExecution().toString()


def test_samples_are_the_same_for_any_partitioning(spark):
    rows = spark.range(20_000).withColumn("unit", F.when(F.col("id") % 7 > 0, F.col("id") % 100))
    kept = [{tuple(r) for r in archive.sample_to(rows.repartition(n), ["id", "unit"], 1000).collect()} for n in (1, 3, 5)]
    assert kept[0] == kept[1] == kept[2] and 850 < len(kept[0]) < 1150
    assert kept[0] != {tuple(r) for r in archive.sample_to(rows, ["id", "unit"], 1000, seed=2).collect()}


def test_services_are_asked_once(spark, tmp_path):
    def answer(names):
        for n in names:
            (tmp_path / f"{n}-{len(list(tmp_path.glob(f'{n}-*')))}").touch()
        return ['{"results":[]}' for _ in names]

    rows = spark.createDataFrame([("a",), ("a",), ("b",)], "name string")
    found = terminology.resolve_by_service(rows, answer, terminology.Resolution("name", "term", "T", on_not_resolvable=terminology.KEEP), parallelism=2)
    assert found.count() == 3 and sorted(r["term"] for r in found.collect()) == ["a", "a", "b"]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a-0", "b-0"]


def test_fetched_lines(spark):
    texts = {"a": "/* x */\nh\n1\t2\n\n3\t4", "b": "h\r\n5\t6\r\n", "c": "", "d": "h"}
    lines = tabular.fetch_lines(spark.createDataFrame([(k,) for k in texts], "doi string"), lambda doi, kind: texts[doi], lines_at_once=1)
    assert sorted(map(tuple, tabular.split_lines(lines, ["p", "q"], "\t", ["doi"]).collect())) == [("a", "1", "2"), ("a", "3", "4"), ("b", "5", "6"), ("d", "h", None)]  # a line without an end is no header


def test_entries_without_metadata_stay(spark):
    from geoloom.operators import catalog

    doc = '{"lastModifiedDate":"1","goesternId":"me","basketContent":{"selected":[{"metadatalink":"http://doi.pangaea.de/10.1/x","title":"own","authors":["a"]}]}}'
    found = catalog.baskets(spark.createDataFrame([("b", doc)], "basket_id string, json string"))
    other = spark.createDataFrame([("10.1/y", '{"name":"other"}')], "doi string, json string")
    for metadata in (None, other):
        row = catalog.typed_entries(found, spark.createDataFrame([], "id string"), metadata).first()
        assert (row["type"], row["doi"], row["title"], row["authors"], row["available"], row["geometry"], row["parameters"]) == ("table", "10.1/x", "own", ["a"], False, "NONE", [])
