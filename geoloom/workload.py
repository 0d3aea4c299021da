"""Queries of the feature engine over the driver's tables, with their SQL.

The tables stand in for the engine's own: parts are taxa, lineitems are occurrences, embeddings are points, customers and
orders are archives, and so on. Each query goes through the operator that it is named for, but for sample_cap, which has no cap.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.functions import attributes, metadata
from geoloom.functions.rect import QueryRect, inside_closed, inside_open
from geoloom.operators import catalog, taxa, terminology
from geoloom.plans import graph
from geoloom.sources import archive, occurrence, tables, tabular


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _points(spark, d):
    e = _read(spark, d, "embeddings")
    return e.select("vec_id", F.get("embedding", 0).cast("double").alias("x"), F.get("embedding", 1).cast("double").alias("y"))


def _terms(spark, d):
    """Parts as terms: taxon, term, level."""
    return _read(spark, d, "part").select(F.col("p_partkey").alias("taxon"), F.col("p_name").alias("term"), F.lower("p_type").alias("level"))


def bbox_closed(spark, d):
    return _points(spark, d).where(inside_closed(F.col("x"), F.col("y"), QueryRect(-0.1, -0.05, 0.1, 0.2)))


def bbox_open(spark, d):
    rows = _read(spark, d, "lineitem").where(inside_open(F.col("l_quantity"), F.col("l_discount"), QueryRect(10, 0.02, 20, 0.05)))
    return rows.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")


def unit_join(spark, d):
    datasets = _read(spark, d, "orders").select(F.col("o_orderkey").alias("surrogate_key"), F.col("o_custkey").alias("dataset_id"))
    units = _read(spark, d, "lineitem").select(F.col("l_orderkey").alias("surrogate_key"), "l_linenumber", "l_extendedprice", "l_quantity")
    rows = archive.units_of(datasets, units, 7, F.col("l_extendedprice"), F.col("l_quantity"), QueryRect(1000, 1, 60000, 40))
    return rows.select("surrogate_key", "l_linenumber", F.col("l_extendedprice").alias("x"), F.col("l_quantity").alias("y"))


def unit_filter(spark, d):
    datasets = _read(spark, d, "orders").select(F.col("o_orderkey").alias("surrogate_key"), F.col("o_custkey").alias("dataset_id"))
    units = _read(spark, d, "lineitem").select(F.col("l_orderkey").alias("surrogate_key"), F.col("l_linenumber").cast("string").alias("unit_id"), "l_extendedprice", "l_quantity")
    rows = archive.units_of(datasets, units, 7, F.col("l_extendedprice"), F.col("l_quantity"), QueryRect(0, 0, 1e9, 1e9), F.col("unit_id"), ["1", "3", "3"])
    return rows.select("surrogate_key", "unit_id", F.col("l_extendedprice").alias("x"), F.col("l_quantity").alias("y"))


def sample_cap(spark, d):
    """All points. There is no cap here, so nothing is sampled: that is done by sample_active, with its own cap."""
    return _points(spark, d)


def sample_active(spark, d):
    return archive.sample_to(_read(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"], 1000)


def taxa_query(spark, d):
    return taxa.resolve_taxa(_terms(spark, d), "red", "ECONOMY")


def taxa_names(spark, d):
    names = _read(spark, d, "part").select(F.col("p_partkey").alias("taxon"), F.col("p_name").alias("name"))
    return taxa.resolve_taxa_names(names, taxa.resolve_taxa(_terms(spark, d), "red", "ECONOMY", distinct=False))


def occ_points(spark, d):
    narrow = _read(spark, d, "lineitem").select(F.col("l_partkey").alias("taxon"), F.col("l_extendedprice").alias("x"), F.col("l_quantity").alias("y"))
    found = taxa.resolve_taxa(_terms(spark, d), "red", "ECONOMY", distinct=False)
    return occurrence.occurrence_points(None, narrow, found, QueryRect(1000, 5, 50000, 45), [], [])


def occ_attributes(spark, d):
    wide = _read(spark, d, "lineitem").select(
        F.col("l_partkey").alias("taxonkey"), F.col("l_extendedprice").alias("decimallongitude"), F.col("l_quantity").alias("decimallatitude"),
        F.col("l_tax").alias("elevation"), F.col("l_returnflag").alias("depth"), F.col("l_linestatus").alias("basisofrecord"),
    )
    found = taxa.resolve_taxa(_terms(spark, d), "red", "ECONOMY", distinct=False)
    rows = occurrence.occurrence_points(wide, None, found, QueryRect(1000, 5, 50000, 45), ["elevation", "depth"], ["basisofrecord"])
    return rows.withColumn("depth", F.isnan("depth"))  # NaN is compared as a flag: engines order and print it differently


def provenance_occ(spark, d):
    narrow = _read(spark, d, "lineitem").select(F.col("l_partkey").alias("taxon"), F.col("l_suppkey").alias("uid"))
    datasets = _read(spark, d, "supplier").join(_read(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    datasets = datasets.select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("citation"), F.col("n_name").alias("uri"))
    red = _read(spark, d, "part").where(F.col("p_name").ilike("red%")).select(F.col("p_partkey").alias("taxon"))
    return occurrence.occurrence_provenance(spark, occurrence.OCCURRENCE_LABEL, narrow, datasets, red)


def provenance_ranges(spark, d):
    return occurrence.occurrence_provenance(spark, "", None, None, None)


def source_counts(spark, d):
    red = _read(spark, d, "part").where(F.col("p_name").ilike("red%"))
    narrow = _read(spark, d, "lineitem").select(F.col("l_partkey").alias("taxon"), F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"))
    ranges = _read(spark, d, "part").select(F.col("p_name").alias("binomial"))
    names = red.select(F.lower("p_name").alias("name"))
    return taxa.data_sources(taxa.count_occurrences(narrow, red.select(F.col("p_partkey").alias("taxon"))), taxa.count_ranges(ranges, names), ("occurrences", "ranges"))


def species_search(spark, d):
    return taxa.search_species(_terms(spark, d), "RED", "Economy")


def _shapes(spark, d):
    return _read(spark, d, "customer").select(F.upper("c_mktsegment").alias("binomial"), F.concat(F.lit("POINT("), F.col("c_custkey"), F.lit(" "), F.col("c_nationkey"), F.lit(")")).alias("geometry_wkt"))


def _segments(spark, d):
    return _read(spark, d, "customer").where("c_mktsegment in ('MACHINERY', 'BUILDING')").select(F.lower("c_mktsegment").alias("name")).distinct()


def collect_geometry(spark, d):
    return occurrence.occurrence_ranges(_shapes(spark, d), _segments(spark, d), by_name=True)


def range_shapes(spark, d):
    return taxa.ranges_of(_shapes(spark, d), _segments(spark, d))


def attr_nan(spark, d):
    c = _read(spark, d, "customer")
    return c.select("c_custkey", F.isnan(attributes.numeric(F.col("c_name"), "v")).alias("is_nan"), attributes.numeric(F.col("c_acctbal"), "balance"), attributes.textual(F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")), "segment"))


def json_field(spark, d):
    e = _read(spark, d, "events").where("event_type = 'click'")
    return e.select("event_id", metadata.json_number(F.col("props"), "$.k").alias("k"))


def archive_points(spark, d):
    return archive.archive_points(*_archive(spark, d), "1-URGENT", QueryRect(0, 0, 60, 40), [WEIGHT], [COLOUR], cap=2000).toDF("x", "y", "weight", "colour")


def archive_units(spark, d):
    """Units of a dataset by their ids, with an attribute."""
    return archive.archive_points(*_archive(spark, d), "2-HIGH", QueryRect(-180, -90, 180, 90), [], [COLOUR], ["1", "5", "5"]).toDF("x", "y", "colour")


WEIGHT, COLOUR = "/DataSets/DataSet/Units/Unit/Weight", "/DataSets/DataSet/Units/Unit/Colour"


def _archive(spark, d):
    """Orders as datasets (one surrogate key each, grouped by priority) and lineitems as their units."""
    datasets = _read(spark, d, "orders").select(F.col("o_orderkey").alias("surrogate_key"), F.col("o_orderpriority").alias("dataset_id"))
    named = {archive.UNIT_ID: F.col("l_linenumber").cast("string"), archive.LONGITUDE: F.col("l_extendedprice") / 1000, archive.LATITUDE: F.col("l_quantity"), WEIGHT: F.col("l_tax"), COLOUR: F.nullif(F.col("l_returnflag"), F.lit("R"))}
    units = _read(spark, d, "lineitem").select(F.col("l_orderkey").alias("surrogate_key"), *[c.alias(attributes.path_hash(p)) for p, c in named.items()])
    return datasets, units


def _customer_archives(spark, d):
    named = {archive.CITATION: F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")), archive.URI: F.concat(F.lit("http://example.org/"), F.col("c_custkey")), archive.LICENSE: F.lit(None).cast("string")}
    return _read(spark, d, "customer").select(F.col("c_name").alias("dataset_id"), *[c.alias(attributes.path_hash(p)) for p, c in named.items()])


def archive_provenance(spark, d):
    return archive.provenance_of(_customer_archives(spark, d))


def _nation_metadata(spark, d):
    """doi and json of a dataset for each nation but those of region 2: nations of region 0 have a point as coverage, those of region 1 a
    box, others coordinate columns."""
    n = _read(spark, d, "nation").where("n_regionkey != 2")
    name = lambda x: F.struct(F.lit(x).alias("name"))
    measured = F.struct(F.lit("Depth").alias("name"), F.lit("m").alias("unitText"))
    coordinates = F.array(F.to_json(name("Latitude")), F.to_json(name("Longitude")), F.to_json(measured))
    key = F.col("n_nationkey").cast("string")
    geo = F.when(F.col("n_regionkey") == 0, F.concat(F.lit('{"@type":"GeoCoordinates","longitude":'), key, F.lit('.5,"latitude":1}')))
    geo = geo.when(F.col("n_regionkey") == 1, F.concat(F.lit('{"@type":"GeoShape","box":"1 '), key, F.lit(' 3.25 40"}')))
    doc = F.concat(
        F.lit('{"name":"'), F.col("n_name"), F.lit('","license":"CC-BY","url":"http://example.org/'), key, F.lit('","creator":{"familyName":"Doe","givenName":"'), F.col("n_name"), F.lit('"}'),
        F.coalesce(F.concat(F.lit(',"spatialCoverage":{"geo":'), geo, F.lit("}")), F.lit("")),
        F.lit(',"variableMeasured":['), F.when(F.col("n_regionkey") > 1, F.array_join(coordinates, ",")).otherwise(F.to_json(measured)), F.lit("]"),
        F.lit(',"distribution":[{"fileFormat":"text/html","contentUrl":"h"},{"fileFormat":"text/tab-separated-values","contentUrl":"t'), key, F.lit('"}]}'),
    )
    return n.select(F.concat(F.lit("10.1/"), key).alias("doi"), doc.alias("json"))


def metadata_entry(spark, d):
    rows = catalog.table_entries(_nation_metadata(spark, d))
    return rows.select("doi", "title", "data_link", "is_georeferenced", "geometry", "column_x", "column_y", "result_type", F.size("parameters").alias("n_parameters"), "usable")


def metadata_coverage(spark, d):
    return metadata.parse_metadata(_nation_metadata(spark, d)).select("doi", "coverage", "coverage_wkt", F.get("authors", 0).alias("author"))


def table_provenance(spark, d):
    cited = _read(spark, d, "nation").where("n_nationkey != 3").select(F.concat(F.lit("10.1/"), F.col("n_nationkey")).alias("doi"), F.concat(F.lit("Doe, "), F.col("n_name")).alias("citation"))
    return tabular.table_provenance(_nation_metadata(spark, d), cited)


def _texts(spark, d):
    """A text table for each nation: comment, header, and a row for each of its customers, of which some can't be read."""
    balance = F.when(F.col("c_custkey") % 7 == 0, "bad").when(F.col("c_custkey") % 11 == 0, "").otherwise(F.col("c_acctbal").cast("string"))
    line = F.concat_ws("\t", F.col("c_custkey"), F.col("c_nationkey"), balance, F.col("c_mktsegment"))
    head = "/* customers\nof a nation */\n" + tabular.header(["Key", "Nation", "Balance", "Note"], "\t") + "\n"
    texts = _read(spark, d, "customer").groupBy(F.concat(F.lit("10.1/"), F.col("c_nationkey")).alias("doi")).agg(F.concat(F.lit(head), F.array_join(F.array_sort(F.collect_list(line)), "\n")).alias("text"))
    return tabular.rows_of(texts, "text", ["Key", "Nation", "Balance", "Note"], "\t", keep=["doi"])


def tabular_points(spark, d):
    params = {"columns": {"x": "Key", "y": "Nation", "numeric": ["Balance"], "textual": ["Note"]}, "on_error": "keep"}
    found = tabular.features(_texts(spark, d), params, QueryRect(10, 2, 1000, 20), keep=["doi"])
    return found.select("doi", "x", "y", F.nanvl("Balance", F.lit(-1.0)).alias("balance"), F.col("Note").alias("note"))


def tabular_shapes(spark, d):
    """Rows of tables without coordinates: the dataset's coverage is the geometry of each row that can be read."""
    covered = metadata.parse_metadata(_nation_metadata(spark, d)).where("coverage != 'NONE'").select("doi", "coverage_wkt")
    params = {"geometry": "wkt", "columns": {"numeric": ["Balance"], "textual": ["Key"]}, "on_error": "skip"}
    found = tabular.features(_texts(spark, d).join(covered, "doi"), params, default_wkt=F.col("coverage_wkt"))
    return found.select("geometry_wkt", F.nanvl("Balance", F.lit(-1.0)).alias("balance"), F.col("Key").alias("key"))


def remote_table(spark, d):
    """Every nation's table as one that is fetched, in tasks: here from its name."""
    dois = _read(spark, d, "nation").select(F.col("n_name").alias("doi"))
    lines = tabular.fetch_lines(dois, lambda doi, kind: "/* of " + doi + " */\nh\n" + "".join(f"{k}\t{c}\n" for k, c in enumerate(doi)))
    return tabular.split_lines(lines, ["place", "letter"], "\t", ["doi"])


def csv_resolver(spark, d):
    """The resolver over points of a CSV file, as a graph."""
    path = f"{tables.shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    c = _read(spark, d, "customer")
    c.select(F.col("c_custkey").alias("X"), F.col("c_nationkey").alias("Y"), F.col("c_mktsegment").alias("Name"), F.col("c_acctbal").alias("Num")).write.option("header", True).csv(path)
    terms = _read(spark, d, "customer").where("c_mktsegment != 'BUILDING'").select(F.lit("segments").alias("terminology"), F.col("c_mktsegment").alias("query"), F.lower("c_mktsegment").alias("label"))
    query = {
        "query_result": "points", "spatial_reference": {"projection": "EPSG:4326", "x1": 0, "x2": 1e9, "y1": 3, "y2": 20},
        "query": {
            "type": "terminology_resolver",
            "params": {"attribute_name": "Name", "resolved_attribute": "term", "terminology": "segments", "key": "label", "match_type": "exact", "first_hit": True, "on_not_resolvable": "EMPTY"},
            "sources": {"points": [{"type": "ogr_source", "params": {"filename": path, "on_error": "abort", "time": "none", "columns": {"x": "X", "y": "Y", "numeric": ["Num"], "textual": ["Name"]}}}]},
        },
    }
    return graph.build(query, graph.Context(spark, {"terms": terms})).select("x", "y", F.col("Num").alias("num"), F.col("Name").alias("name"), "term")


def _basket_documents(spark, d):
    """A basket for each customer, with a tabular entry, a unit and an archive. Keywords of every third are deep in a query, every
    fifth has no date and so is no basket."""
    key, nation = F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string")
    q = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    entries = q(
        '[{"metadatalink":"http://doi.pangaea.de/10.1/', nation, '","title":"own ', key, '"},{"metadatalink":"m","title":"unit","parentIdentifier":"d', nation, '","dcIdentifier":"u', key, '","vatVisualizable":true},',
        '{"metadatalink":"m","title":"', F.col("c_name"), '","dataCenter":"here","authors":["A","B"],"datalink":"d', nation, '","vatVisualizable":', (F.col("c_acctbal") > 0).cast("string"), "}]",
    )
    deep = q('"queryJSON":{"query":{"function_score":{"query":{"filtered":{"query":{"simple_query_string":{"query":"deep ', key, '"}}}}}}}')
    word = F.when(F.col("c_custkey") % 3 == 0, deep).otherwise(q('"queryKeyword":"word ', key, '"'))
    date = F.when(F.col("c_custkey") % 5 != 0, q('"lastModifiedDate":"20', key, '",')).otherwise("")
    doc = q("{", date, '"goesternId":"', F.col("c_mktsegment"), '",', word, ',"basketContent":{"selected":', entries, "}}")
    return _read(spark, d, "customer").select(key.alias("basket_id"), doc.alias("json"))


def _available(spark, d):
    return _read(spark, d, "nation").where("n_regionkey in (1, 3)").select(F.concat(F.lit("d"), F.col("n_nationkey")).alias("id"))


def basket_queries(spark, d):
    return catalog.baskets(_basket_documents(spark, d)).select("basket_id", "query", "timestamp", "owner")


def basket_entries(spark, d):
    found = catalog.typed_entries(catalog.baskets(_basket_documents(spark, d)), _available(spark, d), _nation_metadata(spark, d))
    return found.select("basket_id", "position", "type", "title", F.size("authors").alias("n_authors"), "data_center", "data_link", "unit_id", "doi", "available", "result_type", "geometry", "column_x", F.size("parameters").alias("n_parameters"))


def basket_documents(spark, d):
    found = catalog.baskets(_basket_documents(spark, d))
    return catalog.basket_documents(found, catalog.typed_entries(found, _available(spark, d), _nation_metadata(spark, d)))


def session_gate(spark, d):
    kind = F.when(F.col("s_suppkey") % 2 == 0, "OIDC:").otherwise("LOCAL:")
    segment = F.element_at(F.array(*map(F.lit, ("AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY", "HOUSEHOLD"))), (F.col("s_suppkey") % 5 + 1).cast("int"))
    sessions = _read(spark, d, "supplier").select(F.col("s_name").alias("token"), F.concat(kind, segment).alias("external_id"))
    return catalog.session_baskets(sessions, catalog.baskets(_basket_documents(spark, d))).select("token", "owner", "basket_id")


def allowed_urls(spark, d):
    url = F.concat(F.when(F.col("page_id") % 3 == 0, "/vsicurl/").when(F.col("page_id") % 3 == 1, "/vsicurl_streaming/").otherwise(""), "url")
    return _read(spark, d, "pages").select("page_id", catalog.allowed_url(url).alias("allowed"))


def listing_document(spark, d):
    return catalog.to_document(listing_archives(spark, d), "archives")


def term_queries(spark, d):
    how = terminology.Resolution("name", "term", "NCBITAXON", on_not_resolvable=terminology.KEEP)
    return _read(spark, d, "part").select("p_partkey", how.query_strings(F.col("p_name")).alias("query"))


def query_checks(spark, d):
    """Queries, one for each part, with what is wrong with them and their semantic keys."""
    term = F.substring(F.col("p_name"), F.lit(1), F.col("p_size") % 4 + 1)
    columns = F.when(F.col("p_partkey") % 5 == 0, '"columns":{"numeric":[]}').when(F.col("p_partkey") % 5 == 1, '"columns":{"numeric":["height"],"textual":[]}').otherwise('"columns":{"textual":["depth"],"numeric":[]},"note":1')
    kind = F.when(F.col("p_partkey") % 7 == 0, "nothing").otherwise("occurrence_source")
    query = F.concat(F.lit('{"query_result":"points","query":{"type":"'), kind, F.lit('","params":{"term":"'), term, F.lit('","level":"genus",'), columns, F.lit("}}}"))
    return graph.check_queries(_read(spark, d, "part").select("p_partkey", query.alias("json"))).drop("json")


def resolve_keep(spark, d):
    terms = _read(spark, d, "nation").where("n_regionkey = 1").select(F.lit("nations").alias("terminology"), F.col("n_nationkey").cast("string").alias("query"), F.col("n_name").alias("label"))
    features = _read(spark, d, "events").select("event_id", F.col("user_id").cast("string").alias("user"))
    return terminology.resolve_by_table(features, terms, terminology.Resolution("user", "resolved", "nations", on_not_resolvable=terminology.KEEP))


def resolve_empty(spark, d):
    terms = _read(spark, d, "nation").where("n_regionkey = 1").select(F.lit("nations").alias("terminology"), F.col("n_nationkey").cast("string").alias("query"), F.col("n_name").alias("label"))
    features = _read(spark, d, "events").select("event_id", F.col("user_id").cast("string").alias("user"))
    return terminology.resolve_by_table(features, terms, terminology.Resolution("user", "resolved", "nations", on_not_resolvable=terminology.EMPTY))


def resolve_service(spark, d):
    features = _read(spark, d, "events").select("event_id", F.col("event_type").alias("kind"))
    how = terminology.Resolution("kind", "resolved", "kinds", on_not_resolvable=terminology.KEEP)

    def answer(names):
        return [json.dumps({"results": [{"label": [n.upper()]}]}) if n.startswith("c") else json.dumps({"results": []}) for n in names]

    return terminology.resolve_by_service(features, answer, how, parallelism=4)


def page(spark, d):
    overview = _read(spark, d, "orders").select(F.lit("me").alias("owner"), F.col("o_totalprice").alias("query"), F.col("o_orderdate").alias("timestamp"), F.col("o_orderkey").alias("basket_id"))
    return catalog.list_baskets(overview, "me", 20, 10)[1].select("basket_id", "query")


def event_epoch(spark, d):
    return _read(spark, d, "events").select("event_id", attributes.epoch_seconds(F.col("ts")).alias("epoch"))


def path_hash(spark, d):
    return _read(spark, d, "nation").select("n_nationkey", attributes.path_hash(F.col("n_name")).alias("digest"))


def basket_available(spark, d):
    listing = _read(spark, d, "labels").where("quality = 1").select(F.col("doc_id").cast("string").alias("id")).distinct()
    docs = _read(spark, d, "documents")
    entries = docs.select(F.lit("b").alias("basket_id"), F.array(F.parse_json(F.to_json(F.struct(F.col("source").alias("title"), F.col("doc_id").cast("string").alias("datalink"), (F.col("n_chars") > 100).alias("vatVisualizable"))))).alias("entries"))
    return catalog.typed_entries(entries, listing).select("data_link", "title", "available", "result_type")


def listing_available(spark, d):
    listing = _read(spark, d, "labels").select(F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("available"))
    return catalog.available_archives(listing)


def listing_archives(spark, d):
    c = _read(spark, d, "customer")
    listing = c.select(F.concat(F.lit("l/"), F.col("c_custkey")).alias("link"), F.col("c_name").alias("dataset"), F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("provider"), (F.col("c_acctbal") > 0).alias("available"), (F.col("c_nationkey") > 10).alias("isGeoReferenced"))
    return catalog.archives(listing)


def point_wkt(spark, d):
    return _points(spark, d).select("vec_id", attributes.point_wkt(F.col("x"), F.col("y"), attributes.fixed_text).alias("wkt"))


def box_wkt(spark, d):
    p = _points(spark, d)
    return p.select("vec_id", attributes.box_wkt(F.col("x"), F.col("y"), F.col("x") + 1, F.col("y") + 1, attributes.fixed_text).alias("wkt"))


def graph_resolver(spark, d):
    query = {
        "query_result": "points",
        "spatial_reference": {"projection": "EPSG:4326", "x1": 1000, "x2": 50000, "y1": 5, "y2": 45},
        "query": {
            "type": "terminology_resolver",
            "params": {"attribute_name": "basisofrecord", "resolved_attribute": "status", "terminology": "flags", "on_not_resolvable": "KEEP"},
            "sources": {"points": [{"type": "occurrence_source", "params": {"term": "red", "level": "ECONOMY", "dataSource": "GBIF", "columns": {"numeric": [], "textual": ["basisofrecord"]}}}]},
        },
    }
    wide = _read(spark, d, "lineitem").select(F.col("l_partkey").alias("taxonkey"), F.col("l_extendedprice").alias("decimallongitude"), F.col("l_quantity").alias("decimallatitude"), F.col("l_linestatus").alias("basisofrecord"))
    terms = spark.createDataFrame([("flags", "O", "open"), ("other", "F", "wrong")], "terminology string, query string, label string")
    return graph.build(query, graph.Context(spark, {"occurrences": wide, "taxon_to_term": _terms(spark, d), "terms": terms}))


QUERIES = {
    "bbox_closed": bbox_closed, "bbox_open": bbox_open, "unit_join": unit_join, "unit_filter": unit_filter, "sample_cap": sample_cap, "sample_active": sample_active, "taxa": taxa_query, "taxa_names": taxa_names,
    "occ_points": occ_points, "occ_attributes": occ_attributes, "provenance_occ": provenance_occ, "provenance_ranges": provenance_ranges, "source_counts": source_counts, "species_search": species_search,
    "collect_geometry": collect_geometry, "attr_nan": attr_nan, "json_field": json_field, "resolve_keep": resolve_keep, "resolve_empty": resolve_empty, "resolve_service": resolve_service, "page": page,
    "event_epoch": event_epoch, "path_hash": path_hash, "basket_available": basket_available, "listing_available": listing_available, "listing_archives": listing_archives, "point_wkt": point_wkt, "box_wkt": box_wkt,
    "metadata_entry": metadata_entry, "metadata_coverage": metadata_coverage, "tabular_points": tabular_points, "graph_resolver": graph_resolver, "range_shapes": range_shapes, "archive_points": archive_points,
    "archive_units": archive_units, "archive_provenance": archive_provenance, "table_provenance": table_provenance, "tabular_shapes": tabular_shapes, "remote_table": remote_table, "csv_resolver": csv_resolver,
    "basket_queries": basket_queries, "basket_entries": basket_entries, "basket_documents": basket_documents, "session_gate": session_gate, "allowed_urls": allowed_urls, "listing_document": listing_document,
    "term_queries": term_queries, "query_checks": query_checks,
}

_XY = "embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y"
_TAXA = "SELECT p_partkey FROM part WHERE lower(p_type) = 'economy' AND p_name ILIKE 'red%'"
_OCC = f"FROM lineitem WHERE l_extendedprice > 1000 AND l_extendedprice < 50000 AND l_quantity > 5 AND l_quantity < 45 AND l_partkey IN ({_TAXA})"
_RESOLVE = "SELECT event_id, user_id::VARCHAR AS user, coalesce(n_name, {default}) AS resolved FROM events LEFT JOIN (SELECT * FROM nation WHERE n_regionkey = 1) ON user_id = n_nationkey"
_UNITS = "SELECT o_orderkey AS surrogate_key, {unit}, l_extendedprice AS x, l_quantity AS y FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_custkey = 7 AND {where}"


def _fixed(x: str) -> str:
    return f"CAST(CAST({x} AS DECIMAL(18,6)) AS VARCHAR)"


_BOX = " || ', ' || ".join(f"{_fixed(a)} || ' ' || {_fixed(b)}" for a, b in (("x", "y"), ("x", "y + 1"), ("x + 1", "y + 1"), ("x + 1", "y"), ("x", "y")))

def _kept(seed_and_keys: str, rows: str, cap: int) -> str:
    """The condition of archive.sample_to() on the rows of a named subquery."""
    return f"(SELECT count(*) FROM {rows}) <= {cap} OR substr(md5({seed_and_keys}), 1, 12) < format('{{:012x}}', ({cap << 48} // (SELECT count(*) FROM {rows}))::BIGINT)"


_ARCHIVE = "SELECT o_orderkey, l_linenumber, l_extendedprice / 1000 AS x, l_quantity AS y, l_tax AS weight, CASE WHEN l_returnflag = 'R' THEN '' ELSE l_returnflag END AS colour FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderpriority = '{path}' AND x BETWEEN {x1} AND {x2} AND y BETWEEN {y1} AND {y2}"
_META = "SELECT *, '10.1/' || n_nationkey AS doi FROM nation WHERE n_regionkey != 2"
_WKT = "CASE n_regionkey WHEN 0 THEN 'POINT(' || n_nationkey || '.5 1.0)' WHEN 1 THEN 'POLYGON((' || n_nationkey || '.0 1.0, ' || n_nationkey || '.0 3.25, 40.0 3.25, 40.0 1.0, ' || n_nationkey || '.0 1.0))' ELSE '' END"
_BALANCE = "CASE WHEN c_custkey % 7 = 0 OR c_custkey % 11 = 0 THEN -1.0 ELSE c_acctbal END"
_WORD = "CASE WHEN c_custkey % 3 = 0 THEN 'deep ' ELSE 'word ' END || c_custkey"
_BASKETS = "SELECT *, c_custkey::VARCHAR AS basket_id FROM customer WHERE c_custkey % 5 != 0"
_KNOWN = "SELECT 'd' || n_nationkey AS id FROM nation WHERE n_regionkey IN (1, 3)"
_ENTRIES = f"""
WITH b AS ({_BASKETS}), m AS ({_META}), known AS ({_KNOWN})
SELECT basket_id, 0 AS position, 'table' AS type, coalesce(n_name, 'own ' || c_custkey) AS title, CASE WHEN n_name IS NULL THEN [] ELSE ['Doe, ' || n_name] END AS authors, '{catalog.PUBLISHER}' AS data_center,
  'http://doi.pangaea.de/10.1/' || c_nationkey AS metadata_link, coalesce('t' || n_nationkey, '') AS data_link, '' AS unit_id, '10.1/' || c_nationkey AS doi, n_name IS NOT NULL AS available,
  CASE WHEN n_regionkey = 1 THEN 'polygons' WHEN n_name IS NOT NULL THEN 'points' ELSE 'none' END AS result_type, CASE WHEN n_regionkey <= 1 THEN 'WKT' WHEN n_name IS NOT NULL THEN 'XY' ELSE 'NONE' END AS geometry,
  CASE WHEN n_regionkey > 1 THEN 'Longitude' ELSE '' END AS column_x, (n_name IS NOT NULL)::INTEGER AS n_parameters
FROM b LEFT JOIN m ON c_nationkey = n_nationkey
UNION ALL
SELECT basket_id, 1, 'archive', 'unit', [], '', 'm', 'd' || c_nationkey, 'u' || c_custkey, '', id IS NOT NULL, 'points', '', '', 0 FROM b LEFT JOIN known ON id = 'd' || c_nationkey
UNION ALL
SELECT basket_id, 2, 'archive', c_name, ['A', 'B'], 'here', 'm', 'd' || c_nationkey, '', '', id IS NOT NULL AND c_acctbal > 0, 'points', '', '', 0 FROM b LEFT JOIN known ON id = 'd' || c_nationkey"""
_TEXTS = """CASE WHEN len(authors) = 0 THEN '[]' ELSE '["' || array_to_string(authors, '","') || '"]' END"""
_ENTRY = f"""'{{"authors":' || {_TEXTS} || ',"title":"' || title || '","dataCenter":"' || data_center || '","metadataLink":"' || metadata_link || '","dataLink":"' || data_link || '","available":' || available
  || ',"parameters":' || CASE n_parameters WHEN 1 THEN '[{{"name":"Depth","unit":"m","numeric":true}}]' ELSE '[]' END || ',"resultType":"' || result_type || '","type":'
  || CASE type WHEN 'archive' THEN '"abcd","unitId":"' || unit_id || '"' ELSE '"pangaea","doi":"' || doi || '","format":"' || CASE WHEN available THEN 'text/tab-separated-values' ELSE '' END || '","isTabSeparated":' || available
    || ',"isGeoReferenced":' || available || ',"geometrySpecification":"' || geometry || '"' || CASE geometry WHEN 'XY' THEN ',"column_x":"Longitude","column_y":"Latitude"' ELSE '' END END || '}}'"""
_TERM = "substr(p_name, 1, p_size % 4 + 1)"
_ERROR = f"""CASE WHEN p_partkey % 7 = 0 THEN 'unknown operator ''nothing''' WHEN length({_TERM}) < 3 THEN '`term` needs at least 3 characters' WHEN p_partkey % 5 = 0 THEN '`columns.textual` must be an array'
  WHEN p_partkey % 5 = 1 THEN '`height` is no column of this source' END"""

ORACLE_SQL = {
    "collect_geometry": "SELECT lower(c_mktsegment) AS name, 'GEOMETRYCOLLECTION(' || string_agg(g, ',' ORDER BY g) || ')' AS geometry_wkt FROM (SELECT c_mktsegment, 'POINT(' || c_custkey || ' ' || c_nationkey || ')' AS g FROM customer WHERE c_mktsegment IN ('MACHINERY', 'BUILDING')) GROUP BY ALL",
    "range_shapes": "SELECT upper(c_mktsegment) AS binomial, 'POINT(' || c_custkey || ' ' || c_nationkey || ')' AS geometry_wkt FROM customer WHERE c_mktsegment IN ('MACHINERY', 'BUILDING')",
    "attr_nan": "SELECT c_custkey, TRY_CAST(c_name AS DOUBLE) IS NULL AS is_nan, c_acctbal AS balance, coalesce(nullif(c_mktsegment, 'BUILDING'), '') AS segment FROM customer",
    "event_epoch": "SELECT event_id, epoch_us(ts) / 1e6 AS epoch FROM events",
    "sample_active": f"SELECT l_orderkey, l_linenumber FROM lineitem WHERE {_kept(f"'{archive.SEED}:' || l_orderkey || ':' || l_linenumber", 'lineitem', 1000)}",
    "archive_points": f"WITH u AS ({_ARCHIVE.format(path='1-URGENT', x1=0, x2=60, y1=0, y2=40)}) SELECT x, y, weight, colour FROM u WHERE {_kept(f"'{archive.SEED}:' || o_orderkey || ':' || l_linenumber", 'u', 2000)}",
    "archive_units": f"SELECT x, y, colour FROM ({_ARCHIVE.format(path='2-HIGH', x1=-180, x2=180, y1=-90, y2=90)}) WHERE l_linenumber IN (1, 5)",
    "archive_provenance": "SELECT c_name AS dataset_id, CASE c_mktsegment WHEN 'BUILDING' THEN '' ELSE c_mktsegment END AS citation, '' AS license, 'http://example.org/' || c_custkey AS uri, 'data.archive_source' AS local_identifier FROM customer",
    "metadata_entry": f"SELECT doi, n_name AS title, 't' || n_nationkey AS data_link, true AS is_georeferenced, CASE WHEN n_regionkey > 1 THEN 'XY' ELSE 'WKT' END AS geometry, CASE WHEN n_regionkey > 1 THEN 'Longitude' ELSE '' END AS column_x, CASE WHEN n_regionkey > 1 THEN 'Latitude' ELSE '' END AS column_y, CASE n_regionkey WHEN 1 THEN 'polygons' ELSE 'points' END AS result_type, 1::INTEGER AS n_parameters, true AS usable FROM ({_META})",
    "metadata_coverage": f"SELECT doi, CASE n_regionkey WHEN 0 THEN 'POINT' WHEN 1 THEN 'BOX' ELSE 'NONE' END AS coverage, {_WKT} AS coverage_wkt, 'Doe, ' || n_name AS author FROM ({_META})",
    "table_provenance": f"SELECT doi, CASE WHEN n_nationkey = 3 THEN '' ELSE 'Doe, ' || n_name END AS citation, 'CC-BY' AS license, 'http://example.org/' || n_nationkey AS uri, 'data.tabular_source' AS local_identifier FROM ({_META})",
    "tabular_points": f"SELECT '10.1/' || c_nationkey AS doi, c_custkey::DOUBLE AS x, c_nationkey::DOUBLE AS y, {_BALANCE} AS balance, c_mktsegment AS note FROM customer WHERE c_custkey BETWEEN 10 AND 1000 AND c_nationkey BETWEEN 2 AND 20",
    "tabular_shapes": f"SELECT {_WKT} AS geometry_wkt, {_BALANCE} AS balance, c_custkey::VARCHAR AS key FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <= 1 AND c_custkey % 7 != 0",
    "remote_table": "SELECT n_name AS doi, (i - 1)::VARCHAR AS place, substr(n_name, i, 1) AS letter FROM (SELECT n_name, unnest(range(1, length(n_name) + 1)) AS i FROM nation)",
    "csv_resolver": "SELECT c_custkey::DOUBLE AS x, c_nationkey::DOUBLE AS y, c_acctbal AS num, c_mktsegment AS name, CASE c_mktsegment WHEN 'BUILDING' THEN '' ELSE lower(c_mktsegment) END AS term FROM customer WHERE c_nationkey BETWEEN 3 AND 20",
    "basket_queries": f"SELECT basket_id, {_WORD} AS query, '20' || c_custkey AS timestamp, c_mktsegment AS owner FROM ({_BASKETS})",
    "basket_entries": f"SELECT * EXCLUDE (authors, metadata_link), len(authors)::INTEGER AS n_authors FROM ({_ENTRIES})",
    "basket_documents": f"WITH e AS (SELECT basket_id, string_agg({_ENTRY}, ',' ORDER BY position) AS r FROM ({_ENTRIES}) GROUP BY basket_id) SELECT basket_id, '{{\"query\":\"' || {_WORD} || '\",\"timestamp\":\"20' || c_custkey || '\",\"results\":[' || r || ']}}' AS json FROM ({_BASKETS}) JOIN e USING (basket_id)",
    "session_gate": f"SELECT s_name AS token, owner, basket_id FROM (SELECT s_name, ['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'MACHINERY', 'HOUSEHOLD'][s_suppkey % 5 + 1] AS owner FROM supplier WHERE s_suppkey % 2 = 0) JOIN ({_BASKETS}) ON owner = c_mktsegment",
    "allowed_urls": "SELECT page_id, coalesce(page_id % 3 < 2 AND (starts_with(url, 'http://') OR starts_with(url, 'https://')), false) AS allowed FROM pages",
    "listing_document": "SELECT '{\"archives\":[' || string_agg(j, ',' ORDER BY j) || ']}' AS json FROM (SELECT '{\"link\":\"l/' || c_custkey || '\",\"dataset\":\"' || c_name || '\",\"file\":' || c_custkey || ',\"provider\":\"' || c_mktsegment || '\",\"available\":' || (c_acctbal > 0) || ',\"isGeoReferenced\":' || (c_nationkey > 10) || '}' AS j FROM customer)",
    "term_queries": "SELECT p_partkey, 'query=' || replace(p_name, ' ', '+') || '&terminologies=NCBITAXON&match_type=exact&first_hit=true' AS query FROM part",
    "query_checks": f"SELECT p_partkey, {_ERROR} AS error, CASE WHEN {_ERROR} IS NULL THEN '{{\"params\": {{\"columns\": {{\"numeric\": [], \"textual\": [\"depth\"]}}, \"level\": \"genus\", \"term\": \"' || {_TERM} || '\"}}, \"sources\": {{}}, \"type\": \"occurrence_source\"}}' END AS semantic_key FROM part",
    "bbox_closed": f"SELECT * FROM (SELECT vec_id, {_XY} FROM embeddings) WHERE x BETWEEN -0.1 AND 0.1 AND y BETWEEN -0.05 AND 0.2",
    "bbox_open": "SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem WHERE l_quantity > 10 AND l_quantity < 20 AND l_discount > 0.02 AND l_discount < 0.05",
    "unit_join": _UNITS.format(unit="l_linenumber", where="l_extendedprice BETWEEN 1000 AND 60000 AND l_quantity BETWEEN 1 AND 40"),
    "unit_filter": _UNITS.format(unit="l_linenumber::VARCHAR AS unit_id", where="l_linenumber IN (1, 3)"),
    "sample_cap": f"SELECT vec_id, {_XY} FROM embeddings",
    "taxa": f"SELECT DISTINCT p_partkey AS taxon FROM ({_TAXA})",
    "taxa_names": f"SELECT DISTINCT lower(p_name) AS name FROM part WHERE p_name != '' AND p_partkey IN ({_TAXA})",
    "occ_points": f"SELECT l_extendedprice AS x, l_quantity AS y {_OCC}",
    "occ_attributes": f"SELECT l_extendedprice AS x, l_quantity AS y, l_tax AS elevation, TRY_CAST(l_returnflag AS DOUBLE) IS NULL AS depth, l_linestatus AS basisofrecord {_OCC}",
    "provenance_occ": "SELECT citation, '' AS license, uri, 'data.occurrence_source.occurrences' AS local_identifier FROM (SELECT DISTINCT s_suppkey, s_name AS citation, n_name AS uri FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_name ILIKE 'red%'))",
    "provenance_ranges": f"SELECT '{occurrence.RANGE_CITATION}' AS citation, '{occurrence.RANGE_LICENSE}' AS license, '{occurrence.RANGE_URI}' AS uri, 'data.occurrence_source.ranges' AS local_identifier",
    "source_counts": "SELECT 'occurrences' AS name, count(*) AS count FROM lineitem WHERE l_quantity IS NOT NULL AND l_discount IS NOT NULL AND l_partkey IN (SELECT p_partkey FROM part WHERE p_name ILIKE 'red%') UNION ALL SELECT 'ranges', count(*) FROM part WHERE lower(p_name) IN (SELECT lower(p_name) FROM part WHERE p_name ILIKE 'red%')",
    "species_search": "SELECT p_name AS term FROM part WHERE p_name ILIKE 'RED%' AND lower(p_type) = lower('Economy') ORDER BY p_name",
    "json_field": "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events WHERE event_type = 'click'",
    "resolve_keep": _RESOLVE.format(default="user_id::VARCHAR"),
    "resolve_empty": _RESOLVE.format(default="''"),
    "resolve_service": "SELECT event_id, event_type AS kind, CASE WHEN event_type LIKE 'c%' THEN upper(event_type) ELSE event_type END AS resolved FROM events",
    "page": "SELECT o_orderkey AS basket_id, o_totalprice AS query FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 10 OFFSET 20",
    "path_hash": "SELECT n_nationkey, sha1(n_name) AS digest FROM nation",
    "basket_available": "SELECT d.doc_id::VARCHAR AS data_link, d.source AS title, (l.doc_id IS NOT NULL AND d.n_chars > 100) AS available, 'points' AS result_type FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) l ON d.doc_id = l.doc_id",
    "listing_available": "SELECT doc_id AS id FROM labels WHERE quality = 1",
    "listing_archives": "SELECT 'l/' || c_custkey AS link, c_name AS dataset, c_custkey AS file, c_mktsegment AS provider, c_acctbal > 0 AS available, c_nationkey > 10 AS \"isGeoReferenced\" FROM customer",
    "point_wkt": f"SELECT vec_id, 'POINT(' || {_fixed('x')} || ' ' || {_fixed('y')} || ')' AS wkt FROM (SELECT vec_id, {_XY} FROM embeddings)",
    "box_wkt": f"SELECT vec_id, 'POLYGON((' || {_BOX} || '))' AS wkt FROM (SELECT vec_id, {_XY} FROM embeddings)",
    "graph_resolver": f"SELECT l_extendedprice AS x, l_quantity AS y, l_linestatus AS basisofrecord, CASE l_linestatus WHEN 'O' THEN 'open' ELSE l_linestatus END AS status {_OCC}",
}
