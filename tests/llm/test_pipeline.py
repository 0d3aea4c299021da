import public_tokenizers
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from geoloom.llm import language, mixing, near_copies, quality, simhash
from tests.llm.test_mixing import brute as brute_mix
from tests.llm.test_near_copies import brute as brute_copies


def test_all_queries_are_registered():
    names = entry.queries()
    assert "pipeline" in names
    assert sorted({int(n[2:].split("_")[0]) for n in names if n.startswith("op")}) == list(range(1, 11))
    assert len([n for n in names if n.startswith("op")]) == 10


def test_pipeline_against_stages_by_hand(spark, sf_dir):
    import sentencepiece

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language.train(docs)
    rows = [r for r in docs.collect() if (p := model.predict(r["text"]))[0] != "und" and language.margin(p[1], len(model.languages)) >= corpus_pipeline.LEAST_MARGIN]
    crf = quality.train(docs.where(docs["doc_id"].isin([r["doc_id"] for r in rows])), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = [r for r in rows if quality.judge_text(r["text"], crf)[2]]
    stay = set(brute_copies(rows))
    rows = [r for r in rows if r["doc_id"] in stay]
    taken = brute_mix(rows, mixing.TARGETS, corpus_pipeline.PERCENT, corpus_pipeline.EPOCHS, mixing.SEED)
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = sorted((r["doc_id"], len(lib.encode(r["text"]))) for r in rows if r["doc_id"] in taken)
    got = corpus_pipeline.run(spark, sf_dir)
    assert sorted((r["doc_id"], r["n_tokens"]) for r in got.collect()) == want and want


@pytest.mark.parametrize("k", range(5))
def test_stages_take_odd_rows_and_none(spark, edge, nothing, sf_dir, k):
    name, stage = corpus_pipeline.STAGES[k]
    for docs in (edge, nothing):
        out = stage(spark, docs, sf_dir)
        rows = out.count()
        assert rows <= docs.count()
        assert k == 4 or out.columns == docs.columns, name


def test_near_duplicates_leave_one(spark, sample):
    for keep in (simhash.keep_one, near_copies.keep_one_copy):
        once = keep(sample)
        assert keep(once).count() == once.count()
