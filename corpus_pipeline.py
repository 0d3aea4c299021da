"""The corpus pipeline: language ID, quality rules, near-duplicates, mixing, piece encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's
docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm import language, mixing, near_copies, pieces, quality
from geoloom.llm.common import documents, materialize, remove_tables, written

#: A document's language must be told with this margin over a guess: low, as short and mixed clean documents score little.
LEAST_MARGIN = 0.1
#: Texts are near-duplicates whose sets of shingles of so many words have this Jaccard similarity or more.
SHINGLE, SIMILARITY = 5, 0.8
#: Share of the words that the mixture may take, in per cent, and how often a document may be taken.
PERCENT, EPOCHS = 90, 1


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or in no language that can be told, go. Null texts go; null ids and repeated rows are judged
    like any others; without any row that has a language, all go."""
    return language.keep_identified(docs, language.train(docs), LEAST_MARGIN)


def rate_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules, or have too little content, go. Null and empty texts go; null ids and repeated rows are
    judged like any others; without labels of both kinds only the rules count."""
    return quality.keep_good(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays: five words, a similarity of 0.8 or more.

    SimHash links come first, each confirmed; bands of MinHash values find what is beyond their radius (see near_copies). Null
    texts, texts without words, null ids and repeated rows: as near_copies.keep_one_copy says."""
    return near_copies.keep_one_copy(docs, SHINGLE, SIMILARITY)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture that the target weights and the budget give; a row for each time that a document is taken."""
    taken = mixing.mix(docs, mixing.TARGETS, PERCENT, EPOCHS)[0]
    if EPOCHS == 1:
        return taken.drop("__copies")
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).drop("__copies", "__copy")


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, ids_crc32, round_trip of the documents that are left."""
    return pieces.encode(docs, pieces.model_path())


STAGES = [
    ("language_id", identify_language),
    ("quality_rules", rate_quality),
    ("simhash_near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: SQL can't express the trained stages; tests compare the pipeline with its stages done by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir. What a stage wrote goes once its result is written."""
    docs, since = documents(spark, sf_dir), written()
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        remove_tables(spark, since, keep=1)
    return STAGES[-1][1](spark, docs, sf_dir)
