import json

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from geoloom.functions.metadata import metadata_of, parse_metadata, unique_names
from geoloom.operators.terminology import EMPTY, KEEP, Resolution, resolve_by_service, resolve_by_table, term_of_response


def test_equal_names_get_the_first_free_number():
    assert unique_names(["a", "a", "a1"]) == ["a", "a1", "a11"]
    assert unique_names(["a", "a1", "a"]) == ["a", "a1", "a2"]
    with pytest.raises(RuntimeError):
        unique_names(["a"] * 1002)


@given(st.lists(st.sampled_from(["a", "a1", "b", "a11", ""]), max_size=30))
def test_names_are_unique(names):
    out = unique_names(names)
    assert len(set(out)) == len(names) and all(o.startswith(n) for o, n in zip(out, names, strict=True))


def parsed(spark, document):
    text = document if isinstance(document, str) else json.dumps(document)
    return parse_metadata(spark.createDataFrame([(text,)], "json string")).first()


@pytest.mark.parametrize(
    ("geo", "kind", "wkt"),
    [
        ({"@type": "GeoShape", "box": "1 2 3 4"}, "BOX", "POLYGON((2.0 1.0, 2.0 3.0, 4.0 3.0, 4.0 1.0, 2.0 1.0))"),
        ({"@type": "GeoShape", "box": "1 x 3 4"}, "BOX", "POLYGON((0.0 0.0, 0.0 0.0, 0.0 0.0, 0.0 0.0, 0.0 0.0))"),
        ({"@type": "GeoShape", "box": "1.123456789 2x 3E0 .5,"}, "BOX", "POLYGON((2.0 1.123456789, 2.0 3.0, 0.5 3.0, 0.5 1.123456789, 2.0 1.123456789))"),
        ({"@type": "GeoShape", "box": "1"}, "BOX", "POLYGON((0.0 0.0, 0.0 0.0, 0.0 0.0, 0.0 0.0, 0.0 0.0))"),
        ({"@type": "GeoCoordinates", "longitude": 7.5, "latitude": -2}, "POINT", "POINT(7.5 -2.0)"),
        ({"@type": "Other"}, "NONE", ""),
        (None, "NONE", ""),
    ],
)
def test_coverage(spark, geo, kind, wkt):
    row = parsed(spark, {"name": "n"} | ({"spatialCoverage": {"geo": geo}} if geo else {}))
    assert (row["coverage"], row["coverage_wkt"]) == (kind, wkt)


def test_parameters_authors_and_files(spark):
    row = parsed(spark, {"creator": [{"familyName": "A", "givenName": "B"}, {"familyName": "C"}], "variableMeasured": [{"name": "x", "description": ""}, {"name": "y", "unitText": "m"}], "distribution": {"fileFormat": "f", "contentUrl": "c"}})
    assert row["authors"] == ["A, B", "C, "] and [tuple(p) for p in row["parameters"]] == [("x ", "", False), ("y", "m", True)]
    assert (row["format"], row["data_link"]) == ("f", "c")
    tab = "text/tab-separated-values"
    row = parsed(spark, {"creator": {"familyName": "A", "givenName": "B"}, "distribution": [{"fileFormat": tab, "contentUrl": "1"}, {"fileFormat": f"{tab}; x", "contentUrl": "2"}, {"fileFormat": "z", "contentUrl": "3"}]})
    assert row["authors"] == ["A, B"] and row["data_link"] == "2"
    assert parsed(spark, {"distribution": []})["data_link"] == "" and parsed(spark, "no json")["parameters"] == []


def test_unreadable_metadata_is_an_error(spark):
    with pytest.raises(RuntimeError):
        metadata_of(spark, lambda *_: "no json", "x")


RESPONSES = [
    (None, "", "n"), ("no json", "", "n"), ('{"results": []}', "", "n"), ("{}", "", "n"), ('{"results": [{"other": 1}]}', "", "n"), ('{"results": [{"label": []}]}', "", "n"),
    ('{"results": [{"label": ["a", "b"]}]}', "a", "a"), ('{"results": [{"label": "c"}, {"label": "d"}]}', "c", "c"), ('{"results": [{"label": 5}]}', "5", "5"), ('{"results": [{"label": null}]}', "", ""),
]


@pytest.mark.parametrize(("response", "empty", "keep"), RESPONSES)
def test_responses(spark, response, empty, keep):
    row = spark.createDataFrame([(response, "n")], "r string, n string")
    for mode, expected in ((EMPTY, empty), (KEEP, keep)):
        how = Resolution("a", "b", "t", on_not_resolvable=mode)
        assert row.select(term_of_response(F.col("r"), F.col("n"), how)).first()[0] == expected


@pytest.mark.parametrize("params", [{"terminology": "a,b"}, {"resolved_attribute": "a"}, {"on_not_resolvable": ""}, {"on_not_resolvable": "keep"}, {"match_type": "fuzzy"}])
def test_bad_parameters(params):
    good = {"attribute_name": "a", "resolved_attribute": "b", "terminology": "t", "on_not_resolvable": "KEEP"}
    assert Resolution.from_params(good).first_hit is True
    with pytest.raises(ValueError):
        Resolution.from_params(good | params)


def test_query_string():
    how = Resolution("a", "b", "T", on_not_resolvable=KEEP)
    assert how.query_string("honey bee") == "query=honey+bee&terminologies=T&match_type=exact&first_hit=true"
    assert "first_hit" not in Resolution("a", "b", "T", first_hit=False, on_not_resolvable=KEEP).query_string("x")


TERMS = [("NCBITAXON", "plum", "Prunus domestica"), ("PESI", "honey bee", "Apis mellifera Linnaeus, 1758"), ("NCBITAXON", "honey bee", "Apis mellifera")]


def test_known_lookups(spark):
    terms = spark.createDataFrame(TERMS, "terminology string, query string, label string")
    names = ["plum", "honey bee"] * 20 + ["dose", None]
    rows = spark.createDataFrame(list(enumerate(names)), "i int, name string")
    got = resolve_by_table(rows, terms, Resolution("name", "found", "NCBITAXON", on_not_resolvable=EMPTY)).orderBy("i").collect()
    assert [r["found"] for r in got] == ["Prunus domestica", "Apis mellifera"] * 20 + ["", ""]
    pesi = resolve_by_table(rows, terms, Resolution("name", "found", "PESI", on_not_resolvable=KEEP)).orderBy("i").collect()
    assert [r["found"] for r in pesi[-2:]] == ["dose", ""] and pesi[1]["found"].startswith("Apis mellifera L")


def test_the_service_is_asked_once_a_value(spark, tmp_path):
    log = str(tmp_path / "log")

    def fetch(names):
        with open(log, "a") as f:
            f.writelines(n + "\n" for n in names)
        return [json.dumps({"results": [{"label": n.upper()}]}) if n != "dose" else None for n in names]

    rows = spark.createDataFrame([(i, n) for i, n in enumerate(["plum", "bee"] * 20 + ["dose"])], "i int, name string")
    got = resolve_by_service(rows, fetch, Resolution("name", "found", "T", on_not_resolvable=KEEP)).orderBy("i").collect()
    assert [r["found"] for r in got] == ["PLUM", "BEE"] * 20 + ["dose"]
    assert sorted(open(log).read().split()) == ["bee", "dose", "plum"]
