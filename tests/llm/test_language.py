import zlib

import numpy as np
from pyspark.sql import functions as F

from geoloom.llm import language
from geoloom.llm.common import id_remainder


def test_ids_without_value_count_as_empty(spark):
    rows = spark.createDataFrame([(None,), (7,), (123456,)], "doc_id long").select("doc_id", id_remainder("doc_id", 4).alias("r"))
    assert {r["doc_id"]: r["r"] for r in rows.collect()} == {None: 0, 7: zlib.crc32(b"7") % 4, 123456: zlib.crc32(b"123456") % 4}


def test_frequencies_cover_all_rows(sample):
    docs = sample.withColumn("text", F.substring("text", 1, 300))
    n, seen = language.document_frequencies(docs.repartition(5), "text")
    want, count = np.zeros(language.BUCKETS), 0
    for r in docs.collect():
        if (found := language.ngrams(r["text"])) is not None:
            want[np.unique(found)] += 1
            count += 1
    assert n == count and (seen == want).all()


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language.op6_language(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == docs.count() and len(held) > 150
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    right = np.array([r["lang"] == r["lang_pred"] for r in held])
    scores = np.array([r["score"] for r in held])
    assert right.mean() > 0.97 and abs(right.mean() - scores.mean()) < 0.03 and ((scores >= 0) & (scores <= 1)).all()


def test_odd_rows(edge, sample, nothing):
    model = language.train(sample)
    assert model.languages == ["de", "en", "es", "fr"]
    rows = language.identify(edge, model).collect()
    assert len(rows) == edge.count()
    by_text = {(r["doc_id"]): r for r in rows}
    assert by_text[1]["lang_pred"] == by_text[2]["lang_pred"] == by_text[3]["lang_pred"] == "und" and by_text[1]["score"] == 0
    assert by_text[0]["lang_pred"] == "en" and by_text[6]["lang_pred"] == "en"
    assert language.identify(nothing, model).isEmpty()
    kept = language.keep_identified(edge, model, 0.4)
    assert kept.schema == edge.schema and kept.where("text is null or text = ''").isEmpty() and kept.where("doc_id = 6").count() == 1


def test_nothing_to_learn_from(edge, nothing, sample):
    for docs in (nothing, edge.withColumn("lang", F.lit(None).cast("string"))):
        model = language.train(docs)
        assert model.languages == [] and {r["lang_pred"] for r in language.identify(edge, model).collect()} == {"und"}
    one = language.train(sample.where("lang = 'fr'"))
    assert {(r["lang_pred"], r["score"]) for r in language.identify(sample, one).collect()} == {("fr", 1.0)}


def test_only_text_decides(sample):
    model = language.train(sample)
    mixed = sample.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None)).withColumn("doc_id", -F.col("doc_id"))
    a = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(sample, model).collect()}
    assert a == {-r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(mixed, model).collect()}


def test_penalties_make_weights_sparse():
    rng = np.random.default_rng(0)
    examples = [(rng.choice(1000, 20, replace=False), np.full(20, 0.05), k % 2) for k in range(40)]
    dense, sparse = (language.fit(examples, 2, np.ones(language.BUCKETS), l1=l1)[0] for l1 in (0.0, 0.5))
    assert 0 < np.count_nonzero(sparse) < np.count_nonzero(dense)


def test_temperature():
    logits = np.array([[8.0, 0.0]] * 10)
    labels = np.array([0] * 7 + [1] * 3)
    t = language.calibrate(logits, labels)
    assert abs(language.softmax(logits / t)[0, 0] - 0.7) < 0.01


def test_margins_are_above_a_guess(spark, sample):
    assert language.margin(0.25, 4) == 0 and language.margin(1.0, 4) == language.margin(1.0, 1) == 1 and language.margin(0.5, 2) == 0
    model = language.train(sample)
    scores = {r["doc_id"]: r for r in language.identify(sample, model).collect()}
    for least in (0.1, 0.99):
        kept = {r["doc_id"] for r in language.keep_identified(sample, model, least).collect()}
        assert kept == {i for i, r in scores.items() if r["lang_pred"] != "und" and language.margin(r["score"], len(model.languages)) >= least}
