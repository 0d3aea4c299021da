"""Occurrence source: points of the taxa of a name prefix, and the ranges of their species."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.functions.attributes import OCCURRENCE_COLUMNS, numeric, textual
from geoloom.functions.rect import QueryRect, inside_open
from geoloom.operators.taxa import ranges_of
from geoloom.sources.tables import small

#: The data source whose provenance lists the datasets of occurrences (compared with case), and fixed values of the other.
OCCURRENCE_LABEL = "GBIF"
RANGE_CITATION = "IUCN 2014. The IUCN Red List of Threatened Species. Version 2014.1. http://www.iucnredlist.org. Downloaded on 06/01/2014."
RANGE_LICENSE = "http://spatial-data.s3.amazonaws.com/groups/Red%20List%20Terms%20&%20Conditions%20of%20Use.pdf"
RANGE_URI = "http://www.iucnredlist.org/"


def occurrence_points(wide: DataFrame, narrow: DataFrame, taxa: DataFrame, rect: QueryRect, numeric_names: list[str], textual_names: list[str]) -> DataFrame:
    """x, y and attributes of the occurrences of taxa strictly inside the rectangle.

    Without attributes the narrow table (taxon, x, y) is read, else the wide one. taxa: one column, taxon, repeats allowed.
    Taxa go to every executor if they are few (counted), else both sides are shuffled by taxon.
    """
    for name in (*numeric_names, *textual_names):
        if name not in OCCURRENCE_COLUMNS:
            raise ValueError(f"`{name}` is no column of occurrences")
    if not numeric_names and not textual_names:
        rows = narrow.where(inside_open(F.col("x"), F.col("y"), rect))
        return rows.join(small(taxa), "taxon", "left_semi").select("x", "y")
    x, y = F.col("decimallongitude").cast("double"), F.col("decimallatitude").cast("double")
    rows = wide.where(inside_open(x, y, rect)).join(small(taxa), wide["taxonkey"] == taxa["taxon"], "left_semi")
    return rows.select(x.alias("x"), y.alias("y"), *[numeric(F.col(n), n) for n in numeric_names], *[textual(F.col(n), n) for n in textual_names])


def occurrence_ranges(ranges: DataFrame, names: DataFrame, by_name: bool = False) -> DataFrame:
    """geometry_wkt: the ranges of the named species as one collection, in the order of their texts; no row without any. The
    rectangle is not looked at. That is one value, so one task ends up with all matching shapes; with by_name there is a row
    (name, geometry_wkt) for each species, and tasks share the work. For the shapes themselves, as rows, see taxa.ranges_of().
    """
    shapes = F.array_sort(F.collect_list("geometry_wkt"))
    found = ranges_of(ranges, names).where("geometry_wkt is not null").groupBy(*[F.lower("binomial").alias("name")] * by_name)
    one = found.agg(F.concat(F.lit("GEOMETRYCOLLECTION("), F.array_join(shapes, ","), F.lit(")")).alias("geometry_wkt"), F.count("*").alias("n"))
    return one.where("n > 0").drop("n")


def occurrence_provenance(spark: SparkSession, data_source: str, narrow: DataFrame, datasets: DataFrame, taxa: DataFrame, operator: str = "occurrence_source") -> DataFrame:
    """citation, license, uri, local_identifier: each dataset of occurrences of taxa once, or the one row of ranges.
    The rectangle is not looked at."""
    if data_source != OCCURRENCE_LABEL:
        row = (RANGE_CITATION, RANGE_LICENSE, RANGE_URI, f"data.{operator}.ranges")
        return spark.createDataFrame([row], "citation string, license string, uri string, local_identifier string")
    used = narrow.join(small(taxa), "taxon", "left_semi").select(F.col("uid").alias("key")).distinct()
    rows = datasets.join(used, "key").select("key", "citation", "uri").distinct()
    return rows.select("citation", F.lit("").alias("license"), "uri", F.lit(f"data.{operator}.occurrences").alias("local_identifier"))
