"""Operator graphs: JSON queries become lazily composed DataFrames."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StringType, StructField, StructType

from geoloom.functions.attributes import OCCURRENCE_COLUMNS, check_columns
from geoloom.functions.rect import QueryRect
from geoloom.operators import taxa, terminology
from geoloom.sources import archive, occurrence, tabular

POINTS, LINES, POLYGONS = "points", "lines", "polygons"


@dataclass
class Context:
    """What a graph reads from: tables by name, a fetcher of remote texts, and term tables or a term service.

    Tables: datasets, units, occurrences, occurrences_lite, occurrence_datasets, taxon_to_term, taxon_to_name, ranges, terms.
    aliases: other names of operator types, so that existing queries run as they are.
    """

    spark: SparkSession
    tables: dict[str, DataFrame] = field(default_factory=dict)
    fetch: Callable[[str, str], str] | None = None
    resolve: Callable | None = None
    aliases: dict[str, str] = field(default_factory=dict)
    cache: dict[str, DataFrame] = field(default_factory=dict)

    def table(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise ValueError(f"the table {name} is not there")
        return self.tables[name]

    def kind(self, node: dict) -> str:
        name = self.aliases.get(node.get("type", ""), node.get("type", ""))
        if name not in BUILDERS:
            raise ValueError(f"unknown operator {name!r}")
        return name


def check_node(node: dict, kind: str, aliases: dict[str, str] | None = None) -> str:
    """The operator's name; ValueError for what is wrong with a node and its sources, before any table is looked at."""
    name = (aliases or {}).get(node.get("type", ""), node.get("type", ""))
    if name not in CHECKS:
        raise ValueError(f"unknown operator {name!r}")
    p, sources = node.get("params", {}), [s for group in (node.get("sources") or {}).values() for s in group]
    if name == "terminology_resolver":
        terminology.Resolution.from_params(p)
        if len(sources) != 1:
            raise ValueError("the resolver takes one source")
        check_node(sources[0], kind, aliases)
    elif sources:
        raise ValueError(f"{node['type']} takes no sources")
    CHECKS[name](p, kind)
    return name


def _check_archive(p: dict, kind: str) -> None:
    if kind != POINTS:
        raise ValueError("an archive gives points")
    if not p.get("path"):
        raise ValueError("`path` must name a dataset")
    check_columns(p)


def _check_occurrence(p: dict, kind: str) -> None:
    taxa.check_term(p.get("term", ""))
    check_columns(p, OCCURRENCE_COLUMNS if kind == POINTS else None)
    if kind not in (POINTS, POLYGONS):
        raise ValueError("occurrences give points or polygons")


def _check_tabular(p: dict, kind: str) -> None:
    if kind not in (POINTS, POLYGONS):
        raise ValueError("tables give points or polygons")
    if not p.get("doi"):
        raise ValueError("`doi` must name a dataset")


CHECKS = {"archive_source": _check_archive, "occurrence_source": _check_occurrence, "tabular_source": _check_tabular, "ogr_source": lambda p, kind: None, "terminology_resolver": lambda p, kind: None}


def check_queries(queries: DataFrame, json_col: str = "json", aliases: dict[str, str] | None = None) -> DataFrame:
    """queries with error (what is wrong with a query, null if nothing) and semantic_key (null if something is): by the same
    checks and keys as build(), a row at a time in tasks, for logs of queries. What isn't JSON, or has no operator, is an error."""

    def judge(text: str | None) -> tuple[str | None, str | None]:
        try:
            query = json.loads(text or "")
            check_node(query["query"], query.get("query_result", POINTS), aliases)
            return None, semantic_key(query["query"], aliases)
        except (KeyError, TypeError, AttributeError, json.JSONDecodeError):
            return "not a query", None
        except ValueError as e:
            return str(e), None

    def run(batches):
        for batch in batches:
            found = [judge(t) for t in batch[json_col]]
            yield batch.assign(error=[e for e, _ in found], semantic_key=[k for _, k in found])

    fields = [*queries.schema.fields, StructField("error", StringType()), StructField("semantic_key", StringType())]
    return queries.mapInPandas(run, StructType(fields))


def _archive(node: dict, kind: str, rect: QueryRect, c: Context) -> DataFrame:
    p = node["params"]
    numbers, texts = check_columns(p)
    return archive.archive_points(c.table("datasets"), c.table("units"), p["path"], rect, numbers, texts, p.get("units"), archive.SOFT_CAP)


def _taxa(p: dict, c: Context) -> DataFrame:
    return taxa.resolve_taxa(c.table("taxon_to_term"), taxa.check_term(p.get("term", "")), p.get("level", ""), distinct=False)


def _occurrence(node: dict, kind: str, rect: QueryRect, c: Context) -> DataFrame:
    p = node["params"]
    numbers, texts = check_columns(p)
    found = _taxa(p, c)
    if kind == POLYGONS:
        return occurrence.occurrence_ranges(c.table("ranges"), taxa.resolve_taxa_names(c.table("taxon_to_name"), found))
    return occurrence.occurrence_points(c.tables.get("occurrences"), c.tables.get("occurrences_lite"), found, rect, numbers, texts)


def _tabular(node: dict, kind: str, rect: QueryRect, c: Context) -> DataFrame:
    return tabular.remote_table(c.spark, c.fetch, node["params"]["doi"], node["params"], rect)


def _csv(node: dict, kind: str, rect: QueryRect, c: Context) -> DataFrame:
    return tabular.csv_points(c.spark, node["params"], rect)


def _resolver(node: dict, kind: str, rect: QueryRect, c: Context) -> DataFrame:
    how = terminology.Resolution.from_params(node["params"])
    (source,) = [s for group in node["sources"].values() for s in group]
    features = build_node(source, kind, rect, c)
    if c.resolve:
        return terminology.resolve_by_service(features, lambda names: c.resolve(names, how), how)
    return terminology.resolve_by_table(features, c.table("terms"), how)


BUILDERS = {"archive_source": _archive, "occurrence_source": _occurrence, "tabular_source": _tabular, "ogr_source": _csv, "terminology_resolver": _resolver}


def build_node(node: dict, kind: str, rect: QueryRect, c: Context) -> DataFrame:
    return BUILDERS[check_node(node, kind, c.aliases)](node, kind, rect, c)


def build(query: dict | str, c: Context, cached: bool = False) -> DataFrame:
    """The DataFrame of a query {query_result, spatial_reference, temporal_reference, query}. cached: equal queries share one
    persisted DataFrame."""
    query = json.loads(query) if isinstance(query, str) else query
    rect, kind = QueryRect.from_json(query), query.get("query_result", POINTS)
    if not cached:
        return build_node(query["query"], kind, rect, c)
    key = json.dumps([semantic_key(query["query"], c.aliases), kind, repr(rect)])
    if key not in c.cache:
        c.cache[key] = build_node(query["query"], kind, rect, c).persist()
    return c.cache[key]


#: Parameters of each operator that tell its results apart.
SEMANTIC = {
    "archive_source": ("path", "units", "columns"),
    "occurrence_source": ("dataSource", "term", "level", "columns"),
    "tabular_source": ("doi", "geometry", "time", "separator", "columns", "on_error"),
    "ogr_source": ("filename", "time", "columns", "on_error", "separator"),
    "terminology_resolver": tuple(terminology.Resolution.__dataclass_fields__),
}


def semantic_key(node: dict, aliases: dict[str, str] | None = None) -> str:
    """A text that is the same for nodes that give the same result: known parameters by name, unit ids as a sorted set."""
    kind = (aliases or {}).get(node["type"], node["type"])
    params = {k: v for k, v in node.get("params", {}).items() if k in SEMANTIC[kind]}
    if kind == "terminology_resolver":
        params = vars(terminology.Resolution.from_params(params))
    if params.get("units"):
        params["units"] = sorted(set(params["units"]))
    elif "units" in params:
        del params["units"]
    sources = {k: [semantic_key(s, aliases) for s in v] for k, v in (node.get("sources") or {}).items() if v}
    return json.dumps({"type": kind, "params": params, "sources": sources}, sort_keys=True)


def provenance(query: dict, c: Context) -> DataFrame:
    """citation, license, uri and local_identifier of all sources of a query."""
    node = query["query"]
    p, kind = node.get("params", {}), c.kind(node)
    if kind == "archive_source":
        return archive.archive_provenance(c.table("datasets"), p["path"])
    if kind == "occurrence_source":
        ready = p.get("dataSource") == occurrence.OCCURRENCE_LABEL
        tables = (c.table("occurrences_lite"), c.table("occurrence_datasets"), _taxa(p, c)) if ready else (None, None, None)
        return occurrence.occurrence_provenance(c.spark, p.get("dataSource", ""), *tables)
    if kind == "tabular_source":
        return tabular.remote_provenance(c.spark, c.fetch, p["doi"])
    out = c.spark.createDataFrame([], "citation string, license string, uri string, local_identifier string")
    for group in (node.get("sources") or {}).values():
        for s in group:
            out = out.unionByName(provenance(query | {"query": s}, c))
    return out
