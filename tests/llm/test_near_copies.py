import itertools
import random

import corpus_pipeline
from geoloom.llm import near_copies


def shingles(text, n=5):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if w]
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset()


def brute(rows):
    """Ids that stay, of rows with ids that differ."""
    sets, root = {r["doc_id"]: shingles(r["text"]) for r in rows}, {r["doc_id"]: r["doc_id"] for r in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(sets, 2):
        a, b = sets[i], sets[j]
        if a == b or len(a & b) >= 0.8 * len(a | b):
            x, y = sorted((find(i), find(j)))
            root[y] = x
    return sorted(i for i in root if root[i] == i)


def test_stage_drops_near_copies_of_more_than_two_bits(spark, sample, sf_dir):
    rows = sample.collect()
    want = brute(rows)
    kept = corpus_pipeline.drop_near_duplicates(spark, sample, sf_dir)
    assert kept.columns == sample.columns and sorted(r["doc_id"] for r in kept.collect()) == want
    assert not {145, 177} & set(want)  # near copies of 6 and 1 whose fingerprints differ by 7 and 11 bits


def test_chains_and_groups_against_brute_force(spark):
    words = [f"w{i}" for i in range(400)]
    rows = [(k, " ".join(words[3 * k : 3 * k + 100])) for k in range(60)]  # neighbours are similar, ends are not
    base = [f"v{i}" for i in range(200)]
    rows += [(100 + k, " ".join([*base[: 4 * k], "x", *base[4 * k + 1 :]])) for k in range(40)]
    rows += [(200 + k, " ".join(base[:100] + [f"u{k}_{i}" for i in range(100)])) for k in range(30)]  # a common half
    rows += [(300 + k, f"a b c d e f g h {k % 5}") for k in range(20)] + [(400, ""), (401, None), (402, "a b"), (403, "A  b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r["doc_id"] for r in near_copies.keep_one_copy(docs).collect())
    assert got == brute([{"doc_id": i, "text": t} for i, t in rows])


def test_large_families_against_brute_force(spark, monkeypatch):
    """Groups in which some are near and most have too many changes of their own, with rare and common shingles at small bounds."""
    monkeypatch.setattr(near_copies, "RARE", 3)
    rng = random.Random(4)
    rows = []
    for f, length in enumerate((60, 90, 140)):
        base = [f"f{f}w{i}" for i in range(length)]
        for k in range(90):
            words = list(base)
            for _ in range(rng.choice([1, 1, 2, 3, 4, 6])):
                words[rng.randrange(length)] = rng.choice(["x", "y", f"n{rng.random()}"])
            rows.append((1000 * f + k, " ".join(words[: rng.choice([length, length, length - 9])])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute([{"doc_id": i, "text": t} for i, t in rows])
    assert 30 < len(want) < 260
    assert sorted(r["doc_id"] for r in near_copies.keep_one_copy(docs).collect()) == want


def test_rows_of_one_id_and_null_ids(spark, edge, nothing):
    rows = [(1, "a b c"), (1, "a b c"), (1, "z"), (None, "a b c"), (None, "q"), (None, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(str, (tuple(r) for r in near_copies.keep_one_copy(docs).collect()))) == sorted(map(str, [(1, "a b c"), (1, "z"), (None, "q")]))
    kept = near_copies.keep_one_copy(edge)
    assert kept.columns == edge.columns and len({shingles(r["text"]) for r in edge.collect()}) == kept.count()
    assert near_copies.keep_one_copy(nothing).isEmpty()
