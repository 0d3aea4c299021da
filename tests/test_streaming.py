from pyspark.sql import functions as F

from geoloom.functions.attributes import textual
from geoloom.functions.rect import QueryRect, inside_open
from geoloom.operators.terminology import KEEP, Resolution, resolve_by_table


def test_filters_and_resolver_take_streams(spark, tmp_path):
    rows = [(1.0, 2.0, "plum"), (3.0, 4.0, "dose"), (50.0, 4.0, "plum")]
    spark.createDataFrame(rows, "x double, y double, name string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("x double, y double, name string").parquet(f"{tmp_path}/in")
    terms = spark.createDataFrame([("T", "plum", "Prunus")], "terminology string, query string, label string")
    inside = stream.where(inside_open(F.col("x"), F.col("y"), QueryRect(0, 0, 10, 10))).select("x", textual(F.col("name"), "name"))
    found = resolve_by_table(inside, terms, Resolution("name", "term", "T", on_not_resolvable=KEEP))
    query = found.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select("x", "name", "term").collect()) == [(1.0, "plum", "Prunus"), (3.0, "dose", "dose")]
