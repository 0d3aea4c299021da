"""Tabular sources: text tables behind a comment, with a header made from metadata, and plain CSV files of points."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoloom.functions.attributes import numeric, textual
from geoloom.functions.metadata import metadata_of, parse_metadata
from geoloom.functions.rect import QueryRect, inside_closed

#: The comment up to its end, if there is one, and the line after it, which is the header.
PREAMBLE = r"(?s)\A(?:.*?\*/\n)?[^\n]*\n"
ON_ERROR = ("skip", "keep", "abort")


def strip_preamble(text):
    """A column of texts without comment and header. Without a comment the first line goes all the same."""
    return F.regexp_replace(text, PREAMBLE, "")


def header(names: list[str], separator: str) -> str:
    """Quoted names with the separator between them; quotes inside names stay as they are."""
    return separator.join(f'"{n}"' for n in names)


def rows_of(texts: DataFrame, text_col: str, names: list[str], separator: str, keep: Iterable[str] = ()) -> DataFrame:
    """The data rows of whole-file texts as string columns, behind the columns to keep. Missing fields and empty ones are null."""
    lines = texts.select(*keep, F.explode(F.split(strip_preamble(F.col(text_col)), "\r?\n")).alias("__line")).where("__line != ''")
    return split_lines(lines, names, separator, keep)


def split_lines(lines: DataFrame, names: list[str], separator: str, keep: Iterable[str] = ()) -> DataFrame:
    """The fields of lines (column __line) as string columns."""
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    parsed = lines.select(*keep, F.from_csv("__line", schema.simpleString()[7:-1].replace(":", " "), {"sep": separator, "mode": "PERMISSIVE"}).alias("__r"))
    return parsed.select(*keep, *[F.col(f"__r.c{i}").alias(n) for i, n in enumerate(names)])


def _cell(rows: DataFrame, name: str):
    return F.col(f"`{name.replace('`', '``')}`") if name in rows.columns else None


def features(rows: DataFrame, params: dict, rect: QueryRect | None = None, default_wkt: str | Column | None = None, keep: Iterable[str] = ()) -> DataFrame:
    """The columns to keep, x and y (geometry xy) or geometry_wkt (geometry wkt), and the attributes that params ask for.

    on_error: what happens to rows whose coordinates can't be read, or that lack a number asked for: skip drops the row,
    keep makes it null (coordinates) or NaN, abort is an error. Points outside the closed rectangle are dropped; shapes are
    not held against it: a dataset's coverage is the geometry of all its rows, whatever the query's rectangle is.
    """
    fill = default_wkt if isinstance(default_wkt, Column) else F.lit(default_wkt or "")
    columns, how = params.get("columns") or {}, params.get("on_error", "abort")
    if how not in ON_ERROR:
        raise ValueError(f"`on_error` must be one of {', '.join(ON_ERROR)}")
    numbers, texts = columns.get("numeric") or [], columns.get("textual") or []
    missing = [n for n in (*numbers, *texts) if n not in rows.columns]
    if missing:
        raise ValueError(f"no such columns: {', '.join(missing)}")
    raw = lambda n: F.nullif(F.trim(_cell(rows, n)), F.lit(""))
    number = lambda n: raw(n).cast("double") if how == "abort" else raw(n).try_cast("double")
    bad = [raw(n).isNotNull() & raw(n).try_cast("double").isNull() for n in numbers]
    if params.get("geometry", "xy") == "xy":
        for k in ("x", "y"):
            if columns.get(k) not in rows.columns:
                raise ValueError(f"`columns.{k}` must name a column")
        x, y = number(columns["x"]), number(columns["y"])
        place = [x.alias("x"), y.alias("y")]
        bad += [raw(columns[k]).try_cast("double").isNull() for k in ("x", "y")]
        near = F.coalesce(inside_closed(x, y, rect), F.lit(how == "keep")) if rect else F.lit(True)
    else:
        cell = _cell(rows, columns["x"]) if columns.get("x") else None
        place = [(F.coalesce(cell, fill) if cell is not None else fill).alias("geometry_wkt")]
        near = F.lit(True)
    if how == "skip":
        for b in bad:
            rows = rows.where(~b)
    return rows.where(near).select(*keep, *place, *[F.coalesce(number(n), F.lit(float("nan"))).alias(n) for n in numbers], *[textual(_cell(rows, n), n) for n in texts])


def fetch_lines(dois: DataFrame, fetch: Callable[[str, str], str], lines_at_once: int = 10_000) -> DataFrame:
    """doi and __line of the data rows of remote tables (dois: column doi), fetched in tasks: the driver sees none of them, and a
    task holds one text. Comment and header are left out, as strip_preamble does."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doi in batch["doi"]:
                text = fetch(doi, "table")
                end = text.find("*/\n")
                first = text.find("\n", end + 3 if end >= 0 else 0)
                lines = [x for x in text[first + 1 if first >= 0 else 0 :].replace("\r\n", "\n").split("\n") if x]
                for at in range(0, len(lines), lines_at_once):
                    part = lines[at : at + lines_at_once]
                    yield pd.DataFrame({"doi": [doi] * len(part), "__line": part})

    return dois.select("doi").mapInPandas(run, "doi string, __line string")


def remote_table(spark: SparkSession, fetch: Callable[[str, str], str], doi: str, params: dict, rect: QueryRect) -> DataFrame:
    """Points or shapes of a remote table. fetch(doi, kind) returns the text of kind: metadata, table or citation; tables are
    fetched in a task, so it must be a function that can be sent there.

    Column names come from the metadata. Without coordinate columns the dataset's coverage is the geometry of every row.
    """
    meta = metadata_of(spark, fetch, doi)
    names = [p["name"] for p in meta["parameters"]]
    located = any(n == "LATITUDE" or n.startswith("Latitude") for n in names) and any(n == "LONGITUDE" or n.startswith("Longitude") for n in names)
    lines = fetch_lines(spark.createDataFrame([(doi,)], "doi string"), fetch)
    return features(split_lines(lines, names, params.get("separator", "\t")), params, rect, None if located else meta["coverage_wkt"])


def table_files(spark: SparkSession, path: str, names: list[str], separator: str = "\t") -> DataFrame:
    """The rows of text tables that lie in files, each file read whole."""
    return rows_of(spark.read.text(path, wholetext=True), "value", names, separator)


def table_provenance(metadata: DataFrame, citations: DataFrame, operator: str = "tabular_source") -> DataFrame:
    """doi, citation, license, uri, local_identifier of datasets, from their metadata (doi, json) and citations (doi, citation).
    Without a citation the text is empty."""
    parsed = parse_metadata(metadata.select("doi", "json")).select("doi", "license", F.col("url").alias("uri"))
    return parsed.join(citations.select("doi", "citation"), "doi", "left").select("doi", F.coalesce("citation", F.lit("")).alias("citation"), "license", "uri", F.lit(f"data.{operator}").alias("local_identifier"))


def remote_provenance(spark: SparkSession, fetch: Callable[[str, str], str], doi: str, operator: str = "tabular_source") -> DataFrame:
    metadata = spark.createDataFrame([(doi, fetch(doi, "metadata"))], "doi string, json string")
    return table_provenance(metadata, spark.createDataFrame([(doi, fetch(doi, "citation"))], "doi string, citation string"), operator).drop("doi")


def csv_points(spark: SparkSession, params: dict, rect: QueryRect | None = None) -> DataFrame:
    """Points of a CSV file with a header: params filename, columns, on_error, separator."""
    rows = spark.read.option("header", True).option("sep", params.get("separator", ",")).csv(params["filename"])
    return features(rows, params, rect)
