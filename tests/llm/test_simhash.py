import itertools
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from geoloom.llm import simhash
from geoloom.llm.common import materialize


def brute_print(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if w]
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints):
    root = {i: i for i, _ in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (i, a), (j, b) in itertools.combinations(prints, 2):
        if bin(a ^ b).count("1") <= 2:
            x, y = sorted((find(i), find(j)))
            root[y] = x
    return {i: find(i) for i in root}


def test_documents_against_brute_force(edge, sample, nothing):
    for docs in (edge.where("doc_id is not null").dropDuplicates(["doc_id"]), sample):
        rows = docs.select("doc_id", "text").collect()
        prints = [(r["doc_id"], brute_print(r["text"])) for r in rows]
        want = brute_groups(prints)
        got = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
        assert {i: int(r["fingerprint"], 16) for i, r in got.items()} == dict(prints)
        assert {i: r["component_id"] for i, r in got.items()} == want
    assert simhash.near_duplicates(nothing).isEmpty()


def test_repeated_rows_and_null_ids(edge):
    rows = simhash.near_duplicates(edge).collect()
    assert len(rows) == edge.count()
    assert all(r["component_id"] is not None for r in rows)
    assert [r["component_id"] for r in rows if r["doc_id"] == 0] == [0, 0, 0]


def test_spark_hash_is_the_contracts(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] % (1 << 64) == xxhash.xxh64_intdigest(b"a b c", seed=42)


def pairs(found):
    return {(r["a"], r["b"]) for r in found.collect()}


def some_prints(rng, groups, size, bits):
    prints = set()
    for _ in range(groups):
        base = rng.getrandbits(64)
        for _ in range(size):
            x = base
            for bit in rng.sample(range(64), rng.randint(0, bits)):
                x ^= 1 << bit
            prints.add(simhash._signed(x))
    return prints | {rng.getrandbits(63) for _ in range(50)}


@pytest.mark.parametrize(("count", "bucket"), [(1, 32), (2, 32), (2, 1), (3, 32), (3, 2)])
def test_links_connect_all_that_are_near(spark, monkeypatch, count, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    prints = some_prints(random.Random(5), 8, 25, 3) | some_prints(random.Random(6), 1, 120, 4)
    distinct = materialize(spark.createDataFrame([(p,) for p in prints], "fp long"), "prints")
    linked = pairs(simhash.links(distinct, count))
    assert all(bin((a ^ b) & (1 << 64) - 1).count("1") <= 2 for a, b in linked)
    want = brute_groups([(p, p & (1 << 64) - 1) for p in sorted(prints)])
    root = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(list(linked), "a long, b long")).collect()}
    assert all(root.get(p, p) == want[p] for p in prints)


def test_segments_set_the_candidates_and_most_are_rejected(spark):
    distinct = materialize(spark.createDataFrame([(p,) for p in some_prints(random.Random(5), 12, 25, 6)], "fp long"), "prints")
    none = spark.createDataFrame([], "segment int, value long")
    found = {count: {(min(p), max(p)) for p in map(tuple, simhash.candidates(distinct, none, count).collect())} for count in (1, 2, 3)}
    near = {p for p in found[3] if bin((p[0] ^ p[1]) & simhash.ALL).count("1") <= 2}
    assert found[1] == near and near < found[2] and near < found[3] and found[2] != found[3]  # only a single segment has no false ones
    assert all(near == {p for p in x if bin((p[0] ^ p[1]) & simhash.ALL).count("1") <= 2} for x in found.values())
    assert pairs(simhash.links(distinct, 2)) == near


def test_balls_and_segments():
    assert [len(simhash.ball(m, r)) for m, r in zip(simhash.segments(2), simhash.radii(2), strict=True)] == [1, 33]
    assert simhash.radii(1) == [2] and simhash.radii(3) == [0, 0, 0] and sum(simhash.segments(3)) == simhash.ALL
    with pytest.raises(ValueError, match="segments"):
        simhash.radii(4)


@pytest.mark.parametrize("count", [2, 3])
def test_links_grow_with_the_fingerprints_not_with_their_pairs(spark, count):
    dense = materialize(spark.createDataFrame([(p,) for p in range(4096)], "fp long"), "dense")  # 8 million pairs share their high bits
    found = simhash.links(dense, count)
    assert found.count() <= (simhash.BITS + 1) * 4096
    assert {r["root"] for r in simhash.components(found).collect()} == {0}


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(200)]
    star = [(1000, 1000 + i) for i in range(1, 300)] + [(1299, 999), (5000, 5001), (5001, 5000)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(chain + star, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(201)) and all(got[1000 + i] == 999 for i in range(300)) and got[5001] == 5000
    assert simhash.components(spark.createDataFrame([], "a long, b long")).isEmpty()


def test_stars_of_repeated_edges_and_loops(spark):
    edges = [(1, 2), (2, 1), (1, 2), (3, 3), (2, 4), (4, 7), (7, 4), (9, 8)]
    got = sorted(map(tuple, simhash.stars(spark.createDataFrame(edges, "a long, b long")).select("u", "m").collect()))
    assert got == [(2, 1), (4, 1), (7, 1), (9, 8)]
    loops = spark.createDataFrame([(3, 3)], "a long, b long")
    assert simhash.stars(loops).isEmpty() and simhash.components(loops).isEmpty()


def test_one_of_each_group_stays(edge, sample):
    kept = simhash.keep_one(sample)
    groups = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(sample).collect()}
    assert kept.columns == sample.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, c in groups.items() if i == c)
    assert simhash.keep_one(edge).where("doc_id is null").count() == 2
