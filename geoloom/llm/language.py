"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm.common import documents, filter_rows, groups, id_remainder, map_arrow, map_rows, picked_by_hash

#: Buckets of hashed n-grams, and the orders of n-grams.
BUCKETS, ORDERS = 1 << 16, (1, 2, 3)
#: TF-IDF is term share times inverse document frequency times this.
SCALE = 64.0
UNKNOWN = "und"
#: At most so many languages are learned; more are an error, as the weights grow with them.
MOST_LANGUAGES = 200

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def ngrams(text: str) -> np.ndarray | None:
    """Buckets of all n-grams of a text, with repeats: lower-cased, all but letters as spaces. None if there is no letter."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4")
    known = letters()[points]
    if not known.any():
        return None
    c = np.where(known, points, 32).astype(np.uint32)
    out, h = [], np.zeros(len(c), np.uint32)
    for n in ORDERS:
        h = (h[: len(c) - n + 1] * np.uint32(0x01000193)) + c[n - 1 :] * np.uint32(0x9E3779B1) + np.uint32(n)
        mixed = (h ^ h >> np.uint32(15)) * np.uint32(0x85EBCA6B)
        out.append(mixed >> np.uint32(16))
    return np.concatenate(out)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray  # (BUCKETS,)
    weights: np.ndarray  # (BUCKETS, languages), mostly zeros
    bias: np.ndarray  # (languages,)
    temperature: float = 1.0

    def __post_init__(self):
        self.table = (self.idf[:, None] * self.weights * SCALE).astype(np.float32)

    def predict(self, text: str) -> tuple[str, float]:
        """(language, calibrated probability); UNKNOWN and 0 for a text without a letter."""
        found = ngrams(text) if self.languages else None
        if found is None:
            return UNKNOWN, 0.0
        total = np.zeros(len(self.languages))
        for at in range(0, len(found), 1 << 18):
            total += self.table[found[at : at + (1 << 18)]].sum(axis=0, dtype=np.float64)
        p = softmax((total / len(found) + self.bias) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def document_frequencies(docs: DataFrame, text_col: str) -> tuple[int, np.ndarray]:
    """(documents with a letter, documents that hold each bucket) over all rows: summed in each task, then over tasks."""
    picked = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches):
        total, n, mark = np.zeros(BUCKETS, np.int64), 0, np.zeros(BUCKETS, bool)
        for batch in batches:
            for at, many in groups(batch.column(0)):
                for t in batch.column(0).slice(at, many).to_pylist():
                    if (found := ngrams(t)) is not None:
                        mark[found] = True
                        total += mark
                        mark[:] = False
                        n += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int64()), pa.array(np.append(total[at], n), pa.int64())], names=["bucket", "n"])

    sums = map_arrow(picked, run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out, n = np.zeros(BUCKETS), 0
    for r in sums.collect():  # BUCKETS + 1 rows at most
        if r["bucket"] < 0:
            n = r["n"]
        else:
            out[r["bucket"]] = r["n"]
    return n, out


def fit(examples: list[tuple[np.ndarray, np.ndarray, int]], languages: int, idf: np.ndarray, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01) -> tuple[np.ndarray, np.ndarray]:
    """(weights, bias) by follow-the-regularised-leader with elastic-net penalties. examples: (buckets, term shares, label)."""
    z, n = np.zeros((BUCKETS, languages)), np.zeros((BUCKETS, languages))
    zb, nb = np.zeros(languages), np.zeros(languages)

    def leader(z, n, l1):
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for k in order.permutation(len(examples)):
            at, share, label = examples[k]
            x = share * idf[at] * SCALE
            w, b = leader(z[at], n[at], l1), leader(zb, nb, 0.0)
            error = softmax(x @ w + b)
            error[label] -= 1
            g = x[:, None] * error
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
            zb += error - (np.sqrt(nb + error * error) - np.sqrt(nb)) / alpha * b
            nb += error * error
    return leader(z, n, l1), leader(zb, nb, 0.0)


def calibrate(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search; 1 without examples."""
    if not len(labels):
        return 1.0

    def loss(log_t: float) -> float:
        p = softmax(logits / np.exp(log_t))[np.arange(len(labels)), labels]
        return -np.log(np.maximum(p, 1e-12)).mean()

    lo, hi, ratio = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def train(docs: DataFrame, per_language: int = 400, most_documents: int = 8000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model from docs with a language: document frequencies from all of them, weights from a bounded sample.

    The sample has about per_language whole documents of each language, or fewer so that all have about most_documents, at most
    twice as many, picked by a hash of their ids; a fifth of it sets the temperature, the rest the weights. Null texts and
    texts without a letter teach nothing; ids may be null or repeat; without a language nothing is learned. More than
    MOST_LANGUAGES languages are a ValueError.
    """
    known = docs.where(F.col(lang_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(text_col).alias("__body"), F.col(lang_col).alias("__lang"))
    sizes = {r["__lang"]: r["n"] for r in known.groupBy("__lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    languages = sorted(sizes)
    if not languages:
        return Model([], np.ones(BUCKETS), np.zeros((BUCKETS, 0)), np.zeros(0))
    n, seen = document_frequencies(known, "__body")
    idf = np.log((1 + n) / (1 + seen)) + 1
    per_language = max(1, min(per_language, most_documents // len(languages)))
    shares = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(min(1.0, per_language / sizes[k])))])
    sample = known.where(picked_by_hash("language", "__id", share=F.try_element_at(shares, F.col("__lang")))).withColumn("__place", F.xxhash64(F.lit("language"), "__id"))

    def start():
        def step(texts):
            found = [np.unique(g, return_counts=True) if (g := ngrams(t)) is not None else ([], []) for t in texts]
            return {"at": [a for a, _ in found], "n": [c for _, c in found]}

        return step

    rows = map_rows(sample, start, ["__place", "__lang"], "__body", "at array<int>, n array<int>").where(F.size("at") > 0)
    rows = rows.orderBy("__place", "__lang", "at", "n").limit(2 * per_language * len(languages)).collect()
    index = {k: i for i, k in enumerate(languages)}
    examples = [(np.array(r["at"]), np.array(r["n"]) / sum(r["n"]), index[r["__lang"]]) for r in rows]
    held, used = examples[::5], [x for k, x in enumerate(examples) if k % 5]
    weights, bias = fit(used, len(languages), idf)
    logits = np.array([(s * idf[a] * SCALE) @ weights[a] + bias for a, s, _ in held]).reshape(len(held), len(languages))
    return Model(languages, idf, weights, bias, calibrate(logits, np.array([y for *_, y in held], np.int64)))


def identify(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """One row per document: the kept columns, lang_pred and score (0 to 1).

    Nothing but the text is looked at. Null texts and texts without a letter: 'und' and 0, as for all texts if nothing was
    learned. Null ids and repeated rows stay, one row out for each row in; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages numbers at most

    def start():
        predict = shared.value.predict

        def step(texts):
            found = list(map(predict, texts))
            return {"lang_pred": [a for a, _ in found], "score": [b for _, b in found]}

        return step

    return map_rows(docs, start, list(keep), text_col, "lang_pred string, score double")


def margin(score: float, languages: int) -> float:
    """How far a score is above that of a guess among so many languages: 0 for a guess, 1 for certainty."""
    return (score - 1 / languages) / (1 - 1 / languages) if languages > 1 else score


def keep_identified(docs: DataFrame, model: Model, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs whose language is told with a margin of at least least, with all their columns. Null texts and texts
    without a letter go; repeated rows stay or go together; an empty table gives an empty result."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        known = len(shared.value.languages)
        return lambda texts: [k != UNKNOWN and margin(s, known) >= least for k, s in map(shared.value.predict, texts)]

    return filter_rows(docs, start, text_col)


#: Documents whose id has this remainder are held out.
MODULUS, HELD = 4, 2


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("held_out", id_remainder("doc_id", MODULUS) == HELD)
    return identify(docs, train(docs.where("not held_out")), ("doc_id", "held_out"))


QUERIES = {"op6_language": op6_language}
