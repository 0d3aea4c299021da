"""Near copies by exact similarity of shingle sets: the pipeline's form of operator 3.

Texts with equal sets of shingles are one class and cost no pairs. First the classes' SimHash fingerprints over the same shingles
are linked by multi-index hashing (simhash.links), and each link is confirmed by the exact Jaccard similarity. Fingerprints
of texts at a similarity of 0.8 differ by about 10 of 64 bits, beyond any ball that can be enumerated, so that pass can't be all:
classes that share a band of MinHash values are candidates too. Only two texts that are similar, share none of BANDS bands and
aren't linked through others are missed: at a similarity of 0.8 with a chance of (1 - 0.8 ** ROWS) ** BANDS = 5e-8 a pair.

Bands are worked off in two rounds. First each class is compared with one of each of its bands, the one that meets the most
others: of a large group of near copies that is a text with few changes of its own, the same in most bands, and comparing with it
makes the group one component at a cost that is linear. What is left are pairs of different
components. Most such pairs are texts of one family with too many changes of their own, and an exact bound leaves them out
unseen: call a word sequence rare if at most RARE of the classes left have it. Two sets that share no rare shingle share no
more than the smaller one's common shingles; if that is too little for the similarity, they aren't compared. Sets that share
a rare shingle are found by a join on it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.llm.common import map_rows, materialize
from geoloom.llm.simhash import bit_majority, links, shingle_digests, stars
from geoloom.sources.tables import small

BANDS, ROWS = 32, 4
SEED = 42
#: Classes that a rare shingle may have.
RARE = 16


def shingle_hashes(text: bytes, n: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of n words of a UTF-8 text, as in simhash. No words: none."""
    return np.unique(shingle_digests(text, n))


def bands(hashes: np.ndarray, factors: np.ndarray) -> list[int]:
    """A hash of each band of minima, as signed longs; none for an empty set."""
    import xxhash

    if not len(hashes):
        return []
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1 << 12):
        least = np.minimum(least, (hashes[at : at + (1 << 12), None] * factors).min(axis=0))
    found = np.array([xxhash.xxh64_intdigest(part.tobytes(), k) for k, part in enumerate(least.reshape(-1, ROWS))], np.uint64)
    return found.view(np.int64).tolist()


def _mark(docs: DataFrame, n: int, text_col: str) -> DataFrame:
    """docs with __key (128 bits of the set of shingles), __size (of the set), __fp (its SimHash), __bands and __row (a number of
    its own for each row)."""

    def start():
        import xxhash

        factors = np.random.default_rng(SEED).integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)

        def step(texts):
            sets = [shingle_hashes(t.encode(), n) for t in texts]
            prints = np.array([bit_majority(s) for s in sets], np.uint64).view(np.int64)
            return {"__key": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets], "__size": list(map(len, sets)), "__fp": prints, "__bands": [bands(s, factors) for s in sets]}

        return step

    return map_rows(docs, start, docs.columns, text_col, "__key binary, __size long, __fp long, __bands array<bigint>").withColumn("__row", F.monotonically_increasing_id())


def _confirmed(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of keys whose sets have at least this Jaccard similarity. pairs: a written table, which goes to the sets if
    it has few rows (counted), so that only the sets of one side are shuffled."""
    a, b = sets.select(F.col("__key").alias("a"), F.col("hashes").alias("of_a")), sets.select(F.col("__key").alias("b"), F.col("hashes").alias("of_b"))
    both = F.size(F.array_intersect("of_a", "of_b"))
    return small(pairs).join(a, "a").join(b, "b").where(both / (F.size("of_a") + F.size("of_b") - both) >= similarity).select("a", "b")


def _by_fingerprint(classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of keys: classes of one fingerprint to their smallest, and smallest ones of fingerprints that link."""
    prints = materialize(classes.groupBy("fp").agg(F.min("__key").alias("least")), "prints")
    same = classes.join(prints, "fp").where(F.col("least") < F.col("__key")).select(F.col("least").alias("a"), F.col("__key").alias("b"))
    found = materialize(links(prints.select("fp")).distinct(), "links")
    a, b = prints.select(F.col("fp").alias("a"), F.col("least").alias("x")), prints.select(F.col("fp").alias("b"), F.col("least").alias("y"))
    return same.unionByName(found.join(a, "a").join(b, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))


def _sized(a: str, b: str, similarity: float) -> Column:
    """Whether the sizes of two sets allow the similarity."""
    return F.least(a, b) >= F.greatest(a, b) * similarity


def _centred(met: DataFrame) -> DataFrame:
    """band, __key, size and centre (key and size: the class of the band whose own bands have the most classes) of all classes of
    each band but the centre. met: band, __key, size, n."""
    meets = met.groupBy("__key").agg(F.sum("n").alias("meets"))
    most = met.join(meets, "__key").groupBy("band").agg(F.max(F.struct("meets", F.col("__key").alias("key"), "size")).alias("centre"))
    return met.select("band", "__key", "size").join(most, "band").where(F.col("centre.key") != F.col("__key"))


def _central_pairs(met: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of each class and the centres of its bands."""
    pairs = met.where(_sized("size", "centre.size", similarity))
    return pairs.select(F.least("__key", "centre.key").alias("a"), F.greatest("__key", "centre.key").alias("b")).distinct()


def _sides(rows: DataFrame, *more: str) -> tuple[DataFrame, DataFrame]:
    """Two copies of classes for a join of pairs: band, a and b (keys), and their roots, sizes and more."""
    pick = lambda name: rows.select("band", F.col("__key").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in ("root", "size", *more)])
    return pick("a"), pick("b")


def _apart(similarity: float) -> Column:
    """Whether two sets are of different components, and of sizes that allow the similarity; each pair once."""
    return (F.col("a") < F.col("b")) & (F.col("root_a") != F.col("root_b")) & _sized("size_a", "size_b", similarity)


def _last_pairs(left: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) that share a band, are in different components and may be similar. left: band, __key, root, size."""
    own = left.select("__key", "root", "size").distinct()
    shingles = own.join(sets, "__key").select("__key", "root", "size", F.explode("hashes").alias("band"))
    seen = shingles.groupBy("band").agg(F.count("*").alias("have"), F.min("root").alias("lo"), F.max("root").alias("hi")).where((F.col("have") > RARE) | ((F.col("have") > 1) & (F.col("lo") < F.col("hi"))))
    seen = materialize(shingles.join(seen.select("band", "have"), "band"), "shingles")
    a, b = _sides(seen.where(F.col("have") <= RARE))
    rare = a.join(b, "band").where(_apart(similarity)).select("a", "b")
    common = materialize(seen.where(F.col("have") > RARE).groupBy("__key").agg(F.count("*").alias("common")), "common")
    a, b = _sides(left.join(common, "__key").join(left.groupBy("__key").agg(F.collect_list("band").alias("bands")), "__key"), "common", "bands")
    enough = F.least("common_a", "common_b") * (1 + similarity) >= (F.col("size_a") + F.col("size_b")) * (similarity - 1e-9)
    here = F.array_min(F.array_intersect("bands_a", "bands_b")) == F.col("band")  # of all bands that a pair shares, one is enough
    pairs = a.join(b, "band").where(_apart(similarity) & enough & here).select("a", "b")
    return rare.unionByName(pairs).distinct()


def _rooted(rows: DataFrame, root: DataFrame) -> DataFrame:
    return rows.join(root, rows["__key"] == root["u"], "left").withColumn("root", F.coalesce("m", "__key")).drop("u", "m")


def keep_one_copy(docs: DataFrame, n: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without near copies: of each component of texts with Jaccard similarity of at least similarity over
    shingles of n words one row stays, that with the smallest id, then the smallest hash of its text.

    Rows count, not ids: of repeated rows one stays, and a null id comes after all others. Texts without words are copies of
    each other. All columns of docs stay; an empty table gives an empty result.
    """
    marked = materialize(_mark(docs, n, text_col), "marked", "zstd")
    order = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"), F.col("__row").alias("row"))
    classes = materialize(marked.groupBy("__key").agg(F.min(order).alias("first"), F.count("*").alias("n"), F.any_value("__size").alias("size"), F.any_value("__fp").alias("fp"), F.any_value("__bands").alias("bands")), "classes")

    entries = classes.select("__key", "size", F.explode("bands").alias("band"))
    shared = entries.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    met = materialize(_centred(materialize(entries.join(shared, "band"), "met")), "met")
    pairs = materialize(_by_fingerprint(classes.select("__key", "fp")).unionByName(_central_pairs(met, similarity)).distinct(), "pairs")
    chosen = met.select("__key").union(met.select("centre.key")).union(pairs.select(F.explode(F.array("a", "b")))).distinct()
    chosen = classes.join(chosen, "__key").select(F.col("first.row").alias("__row"))
    texts = marked.select("__key", "__row", text_col).join(small(materialize(chosen, "chosen")), "__row")

    def start():
        return lambda found: {"hashes": [shingle_hashes(t.encode(), n).view(np.int64) for t in found]}

    sets = materialize(map_rows(texts, start, ["__key"], text_col, "hashes array<bigint>"), "sets", "zstd")
    near = materialize(_confirmed(pairs, sets, similarity), "near")
    placed = _rooted(met.select("band", "__key", "size"), stars(near))  # without the centres: they have been compared with all
    several = placed.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi")
    left = materialize(placed.join(several.select("band"), "band"), "left")
    pairs = materialize(_last_pairs(left, sets, similarity), "last")
    near = near.unionByName(materialize(_confirmed(pairs, sets, similarity), "near"))
    root = stars(near)

    rooted = materialize(_rooted(classes.select("__key", "first", "n"), root), "rooted")
    firsts = rooted.groupBy("root").agg(F.min("first").alias("stays"), F.sum("n").alias("rows")).where("rows > 1")
    table = materialize(rooted.join(firsts, "root").select("__key", F.col("stays.row").alias("stays")), "copies")
    gone = materialize(marked.select("__key", "__row").join(table, "__key").where("__row != stays").select("__row"), "gone")
    return marked.join(small(gone), "__row", "left_anti").select(docs.columns)
