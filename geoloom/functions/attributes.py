"""The attribute contract: numbers are doubles with NaN for nothing, texts are strings with "" for nothing."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The columns that occurrence queries may ask for.
OCCURRENCE_COLUMNS = (
    "gbifid", "datasetkey", "occurrenceid", "kingdom", "phylum", "class", "order", "family", "genus", "species", "infraspecificepithet", "taxonrank", "scientificname", "countrycode", "locality",
    "publishingorgkey", "decimallatitude", "decimallongitude", "coordinateuncertaintyinmeters", "coordinateprecision", "elevation", "elevationaccuracy", "depth", "depthaccuracy", "eventdate", "day",
    "month", "year", "taxonkey", "specieskey", "basisofrecord", "institutioncode", "collectioncode", "catalognumber", "recordnumber", "identifiedby", "license", "rightsholder", "recordedby",
    "typestatus", "establishmentmeans", "lastinterpreted", "mediatype", "issue",
)


def unit(name: str = "unknown") -> dict:
    """Column metadata that holds an attribute's unit."""
    return {"unit": name}


def numeric(column: Column, name: str, tolerant: bool = True, unit_name: str = "unknown") -> Column:
    """A numeric attribute. Null gives NaN; so does what isn't a number if tolerant, else it is an error."""
    value = column.try_cast("double") if tolerant else column.cast("double")
    return F.coalesce(value, F.lit(float("nan"))).alias(name, metadata=unit(unit_name))


def textual(column: Column, name: str, unit_name: str = "unknown") -> Column:
    return F.coalesce(column.cast("string"), F.lit("")).alias(name, metadata=unit(unit_name))


def path_hash(path: str | Column) -> str | Column:
    """The physical column name of an XML path, or of a column of paths."""
    return F.sha1(path) if isinstance(path, Column) else hashlib.sha1(path.encode()).hexdigest()


def epoch_seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def check_columns(params: dict, allowed: Sequence[str] | None = None) -> tuple[list[str], list[str]]:
    """(numeric, textual) attribute names of a query's params; ValueError where they are missing, no lists, or not allowed."""
    columns = params.get("columns")
    if not isinstance(columns, dict):
        raise ValueError("`columns` must be an object")
    for kind in ("numeric", "textual"):
        if not isinstance(columns.get(kind), list):
            raise ValueError(f"`columns.{kind}` must be an array")
    names = (list(columns["numeric"]), list(columns["textual"]))
    if allowed is not None:
        for name in (*names[0], *names[1]):
            if name not in allowed:
                raise ValueError(f"`{name}` is no column of this source")
    return names


def fixed_text(x: Column) -> Column:
    """A number as text with six decimals, the same in every engine."""
    return x.cast("decimal(18,6)").cast("string")


def exact_text(x: Column) -> Column:
    """A number as the shortest text that gives the same double again."""
    return x.cast("double").cast("string")


def point_wkt(x: Column, y: Column, text: Callable[[Column], Column] = exact_text) -> Column:
    return F.concat(F.lit("POINT("), text(x), F.lit(" "), text(y), F.lit(")"))


def box_wkt(x1: Column, y1: Column, x2: Column, y2: Column, text: Callable[[Column], Column] = exact_text) -> Column:
    """A rectangle as a closed ring that goes up, right, down and back."""
    corners = [(x1, y1), (x1, y2), (x2, y2), (x2, y1), (x1, y1)]
    ring = F.concat_ws(", ", *[F.concat_ws(" ", text(x), text(y)) for x, y in corners])
    return F.concat(F.lit("POLYGON(("), ring, F.lit("))"))
