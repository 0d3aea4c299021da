"""Terminology resolution: a new textual attribute with the resolved terms of another."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from urllib.parse import urlencode

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.sources.tables import written

EMPTY, KEEP = "EMPTY", "KEEP"
MATCH_TYPES = ("exact", "included", "regex")


@dataclass(frozen=True)
class Resolution:
    """Parameters of the resolver, checked."""

    attribute_name: str
    resolved_attribute: str
    terminology: str
    key: str = "label"
    match_type: str = "exact"
    first_hit: bool = True
    on_not_resolvable: str = ""

    def __post_init__(self):
        if "," in self.terminology:
            raise ValueError("only one terminology can be used at a time")
        if self.attribute_name == self.resolved_attribute:
            raise ValueError("the resolved attribute needs a name of its own")
        if self.on_not_resolvable not in (EMPTY, KEEP):
            raise ValueError("`on_not_resolvable` must be EMPTY or KEEP")
        if self.match_type not in MATCH_TYPES:
            raise ValueError(f"`match_type` must be one of {', '.join(MATCH_TYPES)}")

    @classmethod
    def from_params(cls, params: dict) -> Resolution:
        known = {k: params[k] for k in cls.__dataclass_fields__ if k in params}
        return cls(**({"attribute_name": "", "resolved_attribute": "", "terminology": ""} | known))

    def query_string(self, name: str) -> str:
        """The query of a term search service."""
        parts = {"query": name, "terminologies": self.terminology, "match_type": self.match_type}
        return urlencode(parts | ({"first_hit": "true"} if self.first_hit else {}))

    def query_strings(self, name: Column) -> Column:
        """The queries of a column of names."""
        rest = {"terminologies": self.terminology, "match_type": self.match_type} | ({"first_hit": "true"} if self.first_hit else {})
        return F.concat(F.lit("query="), F.url_encode(name), F.lit("&" + urlencode(rest)))


def term_of_response(response: Column, name: Column, how: Resolution) -> Column:
    """The term in a search response (JSON text, null for a failed request).

    The first result's key counts: a scalar as text, an array by its first element, JSON null as "". No results, no such key
    or an empty array: "" or the name itself, as how says. A response that isn't JSON counts as a failed request.
    """
    default = name if how.on_not_resolvable == KEEP else F.lit("")
    value = F.try_variant_get(F.try_parse_json(response), f"$.results[0]['{how.key}']", "variant")
    kind = F.schema_of_variant(value)
    first = F.try_variant_get(F.try_parse_json(response), f"$.results[0]['{how.key}'][0]", "string")
    empty = kind.startswith("ARRAY") & (F.try_variant_get(F.try_parse_json(response), f"$.results[0]['{how.key}'][0]", "variant").isNull())
    return (
        F.when(value.isNull() | empty, default)
        .when(kind == "VOID", "")
        .when(kind.startswith("ARRAY"), F.coalesce(first, F.lit("")))
        .otherwise(F.coalesce(value.try_cast("string"), F.lit("")))
    )


def resolve_by_table(features: DataFrame, terms: DataFrame, how: Resolution) -> DataFrame:
    """features with the resolved attribute, from a table of terms (terminology, query, <key>); one row a query counts.

    The attribute contract comes first: null values are "" and are looked up as such.
    """
    table = terms.where(F.col("terminology") == how.terminology).groupBy(F.col("query").alias("__query")).agg(F.min(how.key).alias("__term"))
    value = F.coalesce(F.col(how.attribute_name), F.lit(""))
    default = value if how.on_not_resolvable == KEEP else F.lit("")
    joined = features.join(table, value == F.col("__query"), "left")
    return joined.withColumn(how.resolved_attribute, F.coalesce("__term", default)).drop("__query", "__term")


def resolve_by_service(features: DataFrame, fetch: Callable[[Iterable[str]], Iterable[str | None]], how: Resolution, parallelism: int = 16) -> DataFrame:
    """features with the resolved attribute, from a service: fetch turns names into JSON responses, None for a failure.

    Each distinct value is asked for once, spread over parallelism tasks; the answers are written to the shared folder, so that
    they aren't asked for again when the result is read twice or a task that reads them is done again. A task that asks
    and is lost asks again. Filter features before: what comes later does not spare requests.
    """
    values = features.select(F.coalesce(F.col(how.attribute_name), F.lit("")).alias("__query")).distinct().repartition(parallelism)

    def ask(batches: Iterable[pd.DataFrame]):
        for batch in batches:
            yield batch.assign(__response=list(fetch(batch["__query"].tolist())))

    answers = written(values.mapInPandas(ask, "__query string, __response string"), "answers")
    answers = answers.select("__query", term_of_response(F.col("__response"), F.col("__query"), how).alias("__term"))
    joined = features.join(answers, F.coalesce(F.col(how.attribute_name), F.lit("")) == F.col("__query"), "left")
    return joined.withColumn(how.resolved_attribute, F.col("__term")).drop("__query", "__term")
