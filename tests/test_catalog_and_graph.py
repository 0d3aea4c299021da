import json

import pytest

from geoloom.functions.rect import QueryRect
from geoloom.operators import catalog
from geoloom.plans import graph

META = {"name": "T", "variableMeasured": [{"name": "LATITUDE"}, {"name": "Longitude"}, {"name": "Latitude2"}, {"name": "D", "unitText": "m"}], "distribution": {"fileFormat": "text/tab-separated-values", "contentUrl": "u"}}
ENTRIES = [
    {"metadatalink": "http://doi.pangaea.de/10.1/x", "title": "ignored"},
    {"metadatalink": "m", "title": "set", "authors": ["a"], "datalink": "d1", "vatVisualizable": True},
    {"metadatalink": "m", "parentIdentifier": "d1", "dcIdentifier": "u1", "vatVisualizable": True},
    {"metadatalink": "m", "datalink": "d1"},
    {"metadatalink": "m", "datalink": "d2", "vatVisualizable": True},
    {"metadatalink": "m", "vatVisualizable": True},
]
BASKET = {"lastModifiedDate": "2020", "goesternId": "me", "queryKeyword": "k", "basketContent": {"selected": ENTRIES}}


@pytest.fixture
def documents(spark):
    deep = {"lastModifiedDate": "2021", "queryJSON": {"query": {"function_score": {"query": {"filtered": {"query": {"simple_query_string": {"query": "deep"}}}}}}}}
    return spark.createDataFrame([("b", json.dumps(BASKET)), ("c", json.dumps(deep)), ("d", "{}")], "basket_id string, json string")


@pytest.fixture
def available(spark):
    return spark.createDataFrame([("d1",), ("d1",)], "id string")


def test_entries(spark, documents, available):
    meta = spark.createDataFrame([("10.1/x", json.dumps(META))], "doi string, json string")
    rows = {r["position"]: r for r in catalog.basket_entries(documents, available, "b", "me", meta).collect()}
    assert len(rows) == 6
    table = rows[0]
    assert (table["type"], table["doi"], table["title"], table["geometry"], table["column_x"], table["column_y"], table["result_type"], table["available"]) == ("table", "10.1/x", "T", "XY", "Longitude", "Latitude2", "points", True)
    assert [p["name"] for p in table["parameters"]] == ["D"] and table["data_center"] == catalog.PUBLISHER
    assert [rows[i]["available"] for i in range(1, 6)] == [True, True, False, False, False]
    assert (rows[2]["data_link"], rows[2]["unit_id"]) == ("d1", "u1") and rows[1]["authors"] == ["a"]


def test_documents_of_entries(spark, documents, available):
    meta = spark.createDataFrame([("10.1/x", json.dumps(META))], "doi string, json string")
    found = catalog.baskets(documents.where("basket_id in ('b', 'c')"))
    made = {r["basket_id"]: json.loads(r["json"]) for r in catalog.basket_documents(found, catalog.typed_entries(found, available, meta)).collect()}
    assert made["c"] == {"query": "deep", "timestamp": "2021", "results": []}
    table, first = made["b"]["results"][:2]
    assert made["b"]["query"] == "k" and len(made["b"]["results"]) == 6
    assert (table["type"], table["geometrySpecification"], table["column_x"], table["isTabSeparated"], table["doi"]) == ("pangaea", "XY", "Longitude", True, "10.1/x")
    assert first["type"] == "abcd" and first["unitId"] == "" and "doi" not in first and "column_x" not in first and first["resultType"] == "points"


def test_remote_baskets(spark, available):
    documents = catalog.fetch_basket(spark, lambda q: json.dumps(BASKET) if q == "basketID=b" else "", "b")
    assert catalog.basket_entries(documents, available, "b", "me").count() == 6
    for call in (lambda: catalog.fetch_basket(spark, lambda q: "<html>", "b"), lambda: catalog.fetch_baskets(spark, lambda q: "{", "me")):
        with pytest.raises(RuntimeError, match="no JSON"):
            call()


def test_values(spark):
    names = spark.createDataFrame([("b",), ("a",), ("b",)], "term string")
    assert json.loads(catalog.values_document(names, "speciesNames").first()[0]) == {"speciesNames": ["a", "b", "b"]}


def test_tables_of_a_folder(spark, sf_dir):
    from geoloom.sources.tables import from_folder

    assert set(from_folder(spark, sf_dir, ["region", "nation"])["nation"].columns) == {"n_nationkey", "n_name", "n_regionkey"}


def test_access(documents, available):
    with pytest.raises(PermissionError, match="Access denied"):
        catalog.basket_entries(documents, available, "b", "you")
    with pytest.raises(LookupError):
        catalog.basket_entries(documents, available, "d", "me")


def test_query_texts(documents):
    assert {r["basket_id"]: r["query"] for r in catalog.baskets(documents).collect()} == {"b": "k", "c": "deep"}


def test_tabular_entry_without_doi(spark, available):
    bad = BASKET | {"basketContent": {"selected": [{"metadatalink": "http://doi.pangaea.de/"}]}}
    documents = spark.createDataFrame([("b", json.dumps(bad))], "basket_id string, json string")
    meta = spark.createDataFrame([], "doi string, json string")
    with pytest.raises(Exception, match="without DOI"):
        catalog.basket_entries(documents, available, "b", "me", meta).collect()


@pytest.mark.parametrize(
    ("document", "geometry", "result", "usable"),
    [
        ({"spatialCoverage": {"geo": {"@type": "GeoShape", "box": "1 2 3 4"}}}, "WKT", "polygons", True),
        ({"spatialCoverage": {"geo": {"@type": "GeoCoordinates", "longitude": 1, "latitude": 2}}}, "WKT", "points", True),
        ({}, "NONE", "none", False),
    ],
)
def test_table_geometry(spark, document, geometry, result, usable):
    document |= {"distribution": META["distribution"]}
    row = catalog.table_entries(spark.createDataFrame([("d", json.dumps(document))], "doi string, json string")).first()
    assert (row["geometry"], row["result_type"], row["usable"]) == (geometry, result, usable)


def test_pages_and_documents(spark):
    overview = spark.createDataFrame([("me", f"q{i}", f"20{i:02}", i) for i in range(15)] + [("you", "z", "1999", 99)], "owner string, query string, timestamp string, basket_id int")
    total, page = catalog.list_baskets(overview, "me", 10, 10)
    assert total == 15 and [r["basket_id"] for r in page.collect()] == [4, 3, 2, 1, 0]
    listing = spark.createDataFrame([("l", "d", "i", "p", True, False)], "link string, dataset string, id string, provider string, available boolean, isGeoReferenced boolean")
    assert json.loads(catalog.to_document(catalog.archives(listing), "archives").first()[0]) == {"archives": [{"link": "l", "dataset": "d", "file": "i", "provider": "p", "available": True, "isGeoReferenced": False}]}
    asked = []
    got = catalog.fetch_baskets(spark, lambda q: asked.append(q) or json.dumps({"results": [{"queryKeyword": "a", "lastModifiedDate": "1", "basketID": "b"}]}), "me", 10, 5)
    assert tuple(got.first()) == ("a", "1", "b") and asked == ["user=me&from=11&count=5"]


def test_sessions_and_urls(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("OIDC:7", "/vsicurl/http://a"), ("x", "http://a"), (None, None)], "s string, u string")
    assert [tuple(r) for r in rows.select(catalog.session_user(F.col("s")), catalog.allowed_url(F.col("u"))).collect()] == [("7", True), (None, False), (None, False)]


@pytest.mark.parametrize("most", [200_000, 2])
def test_sessions_see_baskets_of_their_user_from_all_tasks(spark, monkeypatch, most):
    from pyspark.sql import functions as F

    from geoloom.sources import tables

    monkeypatch.setattr(tables.small, "__defaults__", (most,))
    tokens = [("t1", "OIDC:a"), ("t2", "OIDC:a"), ("t2", "OIDC:a"), ("t3", "LOCAL:a"), ("t4", "OIDC:"), ("t5", None)]
    sessions = spark.createDataFrame(tokens, "token string, external_id string")
    owner = F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit(""), F.lit(None)), (F.col("id") % 4 + 1).cast("int"))
    found = catalog.session_baskets(sessions, spark.range(4000).coalesce(1).select(F.col("id").alias("basket_id"), owner.alias("owner")))
    rows = found.select("token", "basket_id", F.spark_partition_id().alias("task")).collect()
    assert sorted((r["token"], r["basket_id"]) for r in rows) == sorted((t, b) for t in ("t1", "t2", "t2") for b in range(0, 4000, 4))
    if most > 2:  # one task read the baskets of one owner, and no task makes more than its share of rows
        n = [sum(r["task"] == k for r in rows) for k in {r["task"] for r in rows}]
        assert len(n) >= 8 and max(n) <= 2 * len(rows) / len(n)


CSV = "X,Y,Name,Num\n1,2,plum,1\n3,4,honey bee,2\n5,6,dose,3\n200,0,plum,4\n"


def query(path, **more):
    return {
        "query_result": "points", "spatial_reference": {"projection": "EPSG:4326", "x1": -180, "x2": 180, "y1": -90, "y2": 90}, "temporal_reference": {"type": "UNIX", "start": 0},
        "query": {
            "type": "terminology_resolver", "params": {"attribute_name": "Name", "resolved_attribute": "bla", "terminology": "NCBITAXON", "key": "label", "match_type": "exact", "first_hit": True, "on_not_resolvable": "KEEP"} | more,
            "sources": {"points": [{"type": "ogr_source", "params": {"filename": str(path), "on_error": "abort", "time": "none", "columns": {"x": "X", "y": "Y", "textual": ["Name", "Num"]}}}]},
        },
    }


def test_resolver_over_csv(spark, tmp_path):
    (tmp_path / "t.csv").write_text(CSV)
    terms = spark.createDataFrame([("NCBITAXON", "plum", "Prunus domestica"), ("NCBITAXON", "honey bee", "Apis mellifera")], "terminology string, query string, label string")
    context = graph.Context(spark, {"terms": terms}, aliases={"my_csv": "ogr_source"})
    rows = graph.build(json.dumps(query(tmp_path / "t.csv")), context).orderBy("x").collect()
    assert [(r["x"], r["Name"], r["Num"], r["bla"]) for r in rows] == [(1.0, "plum", "1", "Prunus domestica"), (3.0, "honey bee", "2", "Apis mellifera"), (5.0, "dose", "3", "dose")]
    q = query(tmp_path / "t.csv")
    q["query"] = q["query"]["sources"]["points"][0] | {"type": "my_csv"}
    assert graph.build(q, context).count() == 3
    a, b = graph.build(q, context, cached=True), graph.build(q, context, cached=True)
    assert a is b


def test_semantic_keys():
    a = {"type": "archive_source", "params": {"path": "p", "units": ["b", "a", "a"], "columns": {"numeric": [], "textual": []}, "note": 1}}
    b = {"type": "archive_source", "params": {"columns": {"textual": [], "numeric": []}, "units": ["a", "b"], "path": "p"}}
    assert graph.semantic_key(a) == graph.semantic_key(b) != graph.semantic_key(b | {"params": b["params"] | {"path": "q"}})
    assert graph.semantic_key(query("f")["query"]) == graph.semantic_key({**query("f")["query"], "params": {k: v for k, v in query("f")["query"]["params"].items() if k != "first_hit"}})


def test_bad_graphs(spark):
    context, rect = graph.Context(spark), QueryRect(0, 0, 1, 1)
    for node in (
        {"type": "nothing"}, {"type": "terminology_resolver", "params": query("f")["query"]["params"]}, {"type": "occurrence_source", "params": {"term": "ab", "columns": {"numeric": [], "textual": []}}},
        {"type": "occurrence_source", "params": {"term": "abc"}}, {"type": "ogr_source", "params": {}, "sources": {"points": [{}]}},
    ):
        with pytest.raises(ValueError):
            graph.build_node(node, "points", rect, context)
