import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from geoloom.llm import lattice_lm as lm
from geoloom.llm.common import id_remainder

PIECES = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def vocabulary():
    return lm.Vocabulary.load(PIECES)


def brute(word, v, logs):
    """Log probability by listing all segmentations into pieces."""
    w = lm.MARK + word

    def rest(i):
        if i == len(w):
            return math.exp(logs[lm.STOP])
        total = 0.0
        for j in range(i + 1, len(w) + 1):
            t = w[i:j]
            if t in v.ids and (i == 0 or t[0] != lm.MARK):
                total += math.exp(logs[v.ids[t]]) * rest(j)
        if i and (w[i] == lm.MARK or w[i] not in v.ids):
            total += math.exp(sum(logs[b] for b in v.spelling(w[i]))) * rest(i + 1)
        return total

    return math.log(rest(0))


WORDS = sorted(["a", "the", "there", "thereon", "therein,", "é", "日本x", "a▁b", "▁", "🎉", "x=1", "\x1c"])


def test_forward_sums_all_segmentations(vocabulary):
    for counts in ({}, {vocabulary.ids["he"]: 50, vocabulary.ids["▁t"]: 9, lm.STOP: 20}):
        logs = lm.log_probabilities(vocabulary, counts)
        got = lm.Lattice(vocabulary, logs).marginals(WORDS)
        for w, x in zip(WORDS, got, strict=True):
            assert x == pytest.approx(brute(w, vocabulary, logs), rel=1e-9)


def test_both_sides_are_distributions(vocabulary):
    logs = lm.log_probabilities(vocabulary, {vocabulary.ids["he"]: 50, lm.STOP: 20})
    first = [i for p, i in vocabulary.ids.items() if p[0] == lm.MARK]
    assert sum(math.exp(logs[i]) for i in first) == pytest.approx(1)
    assert sum(math.exp(x) for i, x in logs.items() if i not in set(first)) == pytest.approx(1)


def paths(word, v):
    """All segmentations of a word, as lists of events."""
    w = lm.MARK + word

    def rest(i):
        if i == len(w):
            yield [lm.STOP]
            return
        for j in range(i + 1, len(w) + 1):
            t = w[i:j]
            if t in v.ids and (i == 0 or t[0] != lm.MARK):
                yield from ([v.ids[t], *p] for p in rest(j))
        if i and (w[i] == lm.MARK or w[i] not in v.ids):
            yield from ([*v.spelling(w[i]), *p] for p in rest(i + 1))

    return rest(0)


def test_expected_counts_are_those_of_all_segmentations(vocabulary):
    logs = lm.log_probabilities(vocabulary, {vocabulary.ids["he"]: 50.0, lm.STOP: 20.0})
    weights = [0.5 + k for k in range(len(WORDS))]
    want = Counter()
    for w, weight in zip(WORDS, weights, strict=True):
        all_paths = [(p, math.exp(sum(logs[e] for e in p))) for p in paths(w, vocabulary)]
        whole = sum(x for _, x in all_paths)
        for p, x in all_paths:
            for e in p:
                want[e] += weight * x / whole
    got = lm.Lattice(vocabulary, logs).expected_counts(WORDS, weights)
    assert got.keys() == {e for e, n in want.items() if n} and all(n == pytest.approx(want[e], rel=1e-9) for e, n in got.items())


def test_rounds_raise_the_likelihood(vocabulary, sample):
    words = sorted({w for r in sample.collect() for w in (r["text"] or "").lower().split()})[:4000]
    counts, sums = {}, []
    for _ in range(4):
        lattice = lm.Lattice(vocabulary, lm.log_probabilities(vocabulary, counts, prior=1e-6))
        sums.append(sum(lattice.marginals(words)))
        counts = lattice.expected_counts(words, [1.0] * len(words))
    assert sums == sorted(sums)


def test_very_long_words_stay_finite(vocabulary):
    (x,) = lm.Lattice(vocabulary, lm.log_probabilities(vocabulary, {})).marginals(["the" * 20_000])
    assert -math.inf < x < -1000


def tokens(text):
    return (text or "").encode().lower().split() + [None]


def check(docs, held, rows):
    train = Counter()
    for r in docs:
        if not held(r):
            train.update(tokens(r["text"]))
    n, v = sum(train.values()), len(train)
    want = []
    for r in docs:
        t = tokens(r["text"])
        want.append((r["doc_id"], held(r), len(t), sum(train[x] > 0 for x in t), n, round(sum(math.log10((train[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t), 4)))
    got = [(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert all(-math.inf < r["score"] < 0 for r in rows)


def test_base_columns_against_brute_force(spark, edge, sample, nothing):
    for docs in (edge, sample):
        rows = lm.score(docs, id_remainder("doc_id", 5) == 1, PIECES).collect()
        check(docs.collect(), lambda r: zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % 5 == 1, rows)
    assert lm.score(nothing, F.lit(False), PIECES).isEmpty()


def test_chunks_do_not_change_results(sample, monkeypatch):
    held = id_remainder("doc_id", 5) == 1
    one = {r["doc_id"]: r["score"] for r in lm.score(sample, held, PIECES).collect()}
    monkeypatch.setattr(lm, "CHUNK_TOKENS", 50)
    many = {r["doc_id"]: r["score"] for r in lm.score(sample.repartition(7), held, PIECES).collect()}
    assert one.keys() == many.keys() and all(one[k] == pytest.approx(many[k], rel=1e-9) for k in one)


def test_nothing_to_learn_from(edge):
    rows = lm.score(edge, F.lit(True), PIECES).collect()
    assert len(rows) == edge.count() and all(r["train_tokens"] == 0 and r["n_known"] == 0 and r["score"] < 0 for r in rows)


def test_all_tokens_share_one_unit_of_probability():
    """With lattice probabilities that sum to 1 over known and unknown words, the tokens' probabilities sum to 1."""
    counts = np.array([1.0] * 8 + [2.0] * 4 + [3.0] * 3 + [4.0, 16.0])
    mass = lm.Mass(tokens=int(counts.sum()) + 10, distinct=18, ends=10, known=17, times=(8, 4, 3, 1))
    assert (0 < mass.discounts[1:]).all() and (mass.discounts[1:] < [1, 2, 3]).all()
    known = 10 ** mass.word(counts, np.full(17, math.log(1 / 34)))
    novel = 10 ** mass.word(np.array([0.0]), np.array([math.log(0.5)]))
    assert known.sum() + novel[0] + 10**mass.end == pytest.approx(1)


def test_every_round_is_over_all_words(spark, vocabulary):
    words = sorted({f"w{i * 7919 % 100003}" for i in range(32_000)} | {f"the{i}ing" for i in range(4_000)})
    mass = lm.Mass(40_000, 36_001, 4_000, 36_000, (36_000, 0, 0, 0))
    want = {}
    for _ in range(lm.ROUNDS):
        want = lm.Lattice(vocabulary, lm.log_probabilities(vocabulary, want)).expected_counts(words, [0.5] * len(words))
    got = lm._learned_counts(spark.createDataFrame([(w.encode(), 1) for w in words], "word binary, c long"), vocabulary, mass)
    assert got.keys() == want.keys() and all(n == pytest.approx(want[e], rel=1e-6) for e, n in got.items())


def test_scores_against_all_segmentations(spark, vocabulary):
    """The whole model by hand: counts, discounts, rounds of expected counts, and each word's sum over its edge and all paths."""
    texts = ["the thereon a the", "a ere the in", "Thereon in? \u00e9 a", None, "x", "in ere b", "the new therein word"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    train = Counter(w for t in texts[:6] for w in (t or "").lower().split())
    times = tuple(sum(c == k for c in train.values()) for k in range(1, 5))
    tokens = sum(train.values()) + 6
    d = (0.5, 0.5, 0.5)
    if min(times):
        y = times[0] / (times[0] + 2 * times[1])
        d = tuple(k - (k + 1) * y * times[k] / times[k - 1] for k in (1, 2, 3))
        d = tuple(min(0.95 * k, max(0.1, x)) for k, x in enumerate(d, 1))
    taken = {w: d[min(c, 3) - 1] for w, c in train.items()}
    counts = {}
    for _ in range(lm.ROUNDS):
        logs, now = lm.log_probabilities(vocabulary, counts), Counter()
        for w in train:
            each = [(p, math.exp(sum(logs[e] for e in p))) for p in paths(w, vocabulary)]
            for p, x in each:
                now.update({e: 0.0 for e in p})
                for e in p:
                    now[e] += taken[w] * x / sum(y for _, y in each)
        counts = now
    logs = lm.log_probabilities(vocabulary, counts)

    def log10(w):
        return math.log10((train[w] - taken.get(w, 0) + (sum(taken.values()) + 0.25) * math.exp(brute(w, vocabulary, logs))) / (tokens + 0.5))

    want = [sum(map(log10, (t or "").lower().split())) + math.log10(6.25 / (tokens + 0.5)) for t in texts]
    got = {r["doc_id"]: r["score"] for r in lm.score(rows, F.col("doc_id") == 6, PIECES).collect()}
    assert [got[k] for k in range(7)] == pytest.approx(want, rel=1e-6)


def test_held_out_texts_are_likelier_than_by_simpler_models(spark):
    """Over held-out texts the model beats the same words with the vocabulary's own scores, and with unknown words spelt by single
    letters of equal chance. The contract's base gives each unknown word one mass, however many there are; it's no distribution."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = id_remainder("doc_id", 5) == 1
    found = lm.score(docs, held, PIECES).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    texts = docs.where(~held).collect()
    train = Counter(w for r in texts for w in tokens(r["text"]))
    n, letters = sum(train.values()), len({b for w in train if w for b in w})
    spelt = [w for r in docs.where(held).collect() for w in tokens(r["text"]) if not train[w]]
    lost = len(train) / (n + len(train))  # Witten-Bell: a word is new as often as it was in training
    plain = sum(math.log10(train[w] / n * (1 - lost)) for r in docs.where(held).collect() for w in tokens(r["text"]) if train[w])
    plain += sum(math.log10(lost) - (len(w) + 1) * math.log10(letters + 1) for w in spelt)
    assert found[0] > plain
    lattice = lm.Lattice(own := lm.Vocabulary.load(PIECES), lm.log_probabilities(own, {}))
    order = sorted({w.decode() for w in spelt})
    known = plain - sum(math.log10(lost) - (len(w) + 1) * math.log10(letters + 1) for w in spelt)
    by_scores = dict(zip(order, lattice.marginals(order), strict=True))
    assert found[0] > known + sum(math.log10(lost) + by_scores[w.decode()] / math.log(10) for w in spelt)


def test_text_ids(spark):
    rows = lm.score(spark.createDataFrame([("a", "x y"), (None, None), ("b", "x")], "doc_id string, text string"), F.col("doc_id") == "b", PIECES).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == ["None", "a", "b"] and {r["n_tokens"] for r in rows} == {1, 2, 3}
