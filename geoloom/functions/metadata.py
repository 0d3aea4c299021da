"""Dataset metadata in JSON-LD: parameters, spatial coverage, authors and the file that holds the data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.functions.attributes import box_wkt, exact_text, point_wkt

TABLE_FORMAT = "text/tab-separated-values"
LEADING_NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"
#: Attempts to tell equal parameter names apart.
MOST_SUFFIXES = 1000


def unique_names(names: list[str]) -> list[str]:
    """Names in order; one that was accepted before gets the first free number, from 1, at its end. Metadata is small and
    each name depends on all before, so this is a loop on the driver."""
    taken: set[str] = set()
    out = []
    for name in names:
        candidate, number = name, 0
        while candidate in taken:
            number += 1
            if number >= MOST_SUFFIXES:
                raise RuntimeError(f"no free name for the parameter {name}")
            candidate = f"{name}{number}"
        taken.add(candidate)
        out.append(candidate)
    return out


def json_number(text: Column, path: str) -> Column:
    """A number in a column of JSON texts; null where it isn't there, no number, or the text no JSON."""
    return F.try_variant_get(F.try_parse_json(text), path, "double")


def is_latitude(name: Column) -> Column:
    return (name == "LATITUDE") | name.startswith("Latitude")


def is_longitude(name: Column) -> Column:
    return (name == "LONGITUDE") | name.startswith("Longitude")


def _text(doc: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(doc, path, "string"), F.lit(""))


def _objects(doc: Column, path: str) -> Column:
    """An array of variants: the elements of an array, a single object as the only element, or none."""
    many = F.try_variant_get(doc, path, "array<variant>")
    one = F.try_variant_get(doc, path, "variant")
    return F.coalesce(many, F.when(one.isNotNull(), F.array(one)), F.array().cast("array<variant>"))


def coverage(geo: Column, text: Callable[[Column], Column] = exact_text) -> tuple[Column, Column]:
    """(kind, geometry) of a coverage's geo object: BOX, POINT or NONE, and WKT ("" for NONE).

    A box reads "south west north east", each by the number that its text begins with; if one can't be parsed or is missing all
    are 0, and the coverage is still a box.
    """
    kind = F.try_variant_get(geo, "$['@type']", "string")
    parts = F.split(_text(geo, "$.box"), " ")
    number = lambda i: F.regexp_extract(F.get(parts, i), LEADING_NUMBER, 0).try_cast("double")
    whole = F.forall(F.sequence(F.lit(0), F.lit(3)), lambda i: number(i).isNotNull())
    south, west, north, east = (F.when(whole, number(F.lit(i))).otherwise(0.0) for i in range(4))
    place = lambda k: F.coalesce(F.try_variant_get(geo, f"$.{k}", "double"), F.lit(0.0))
    shape = F.when(kind == "GeoShape", "BOX").when(kind == "GeoCoordinates", "POINT").otherwise("NONE")
    wkt = F.when(kind == "GeoShape", box_wkt(west, south, east, north, text)).when(kind == "GeoCoordinates", point_wkt(place("longitude"), place("latitude"), text)).otherwise("")
    return shape, wkt


def parse_metadata(documents: DataFrame, json_col: str = "json", text: Callable[[Column], Column] = exact_text) -> DataFrame:
    """documents with: title, license, url, authors, data_link, format, coverage, coverage_wkt, parameters.

    parameters: name (with the description after a space, if there is one, even an empty one), unit, numeric (it has a
    unit); equal names are not told apart yet, see unique_names. authors: "family, given". The data file is the last
    distribution of TABLE_FORMAT, else the last one, else nothing. What isn't JSON gives empty values. text: how coordinates are
    written.
    """
    doc = F.try_parse_json(F.col(json_col))
    geo = F.try_variant_get(doc, "$.spatialCoverage.geo", "variant")
    shape, wkt = coverage(geo, text)
    author = lambda a: F.concat(_text(a, "$.familyName"), F.lit(", "), _text(a, "$.givenName"))
    files = F.transform(_objects(doc, "$.distribution"), lambda d: F.struct(_text(d, "$.fileFormat").alias("format"), _text(d, "$.contentUrl").alias("link")))
    tables = F.filter(files, lambda d: d["format"].contains(TABLE_FORMAT))
    chosen = F.coalesce(F.try_element_at(tables, F.lit(-1)), F.try_element_at(files, F.lit(-1)))

    def parameter(p: Column) -> Column:
        more = F.try_variant_get(p, "$.description", "variant")
        name = F.concat(_text(p, "$.name"), F.when(more.isNotNull(), F.concat(F.lit(" "), _text(p, "$.description"))).otherwise(""))
        unit = _text(p, "$.unitText")
        return F.struct(name.alias("name"), unit.alias("unit"), (unit != "").alias("numeric"))

    return documents.select(
        "*",
        _text(doc, "$.name").alias("title"),
        _text(doc, "$.license").alias("license"),
        _text(doc, "$.url").alias("url"),
        F.transform(_objects(doc, "$.creator"), author).alias("authors"),
        F.coalesce(chosen["link"], F.lit("")).alias("data_link"),
        F.coalesce(chosen["format"], F.lit("")).alias("format"),
        shape.alias("coverage"),
        wkt.alias("coverage_wkt"),
        F.transform(_objects(doc, "$.variableMeasured"), parameter).alias("parameters"),
    )


def metadata_of(spark, fetch: Callable[[str, str], str], identifier: str) -> dict:
    """The parsed metadata of one dataset as a dict, with distinct parameter names. fetch: (identifier, kind) to text."""
    row = parse_metadata(spark.createDataFrame([(fetch(identifier, "metadata"),)], "json string")).first().asDict(recursive=True)
    if not row["title"] and not row["parameters"]:
        raise RuntimeError(f"the metadata of {identifier} can't be read")
    for p, name in zip(row["parameters"], unique_names([p["name"] for p in row["parameters"]]), strict=True):
        p["name"] = name
    return row
