"""SimHash near-duplicates: fingerprints, links by multi-index hashing, and connected components.

Links. A fingerprint is cut into SEGMENTS parts, each with a table of its own that is keyed by the part's value. Two
fingerprints within RADIUS bits differ by no more than radii()[k] bits in some part k: with two parts, either not at all in the
first or by one bit at most in the second. So each fingerprint enumerates a small Hamming ball within each part, fetches the
table's rows at these values, and the complete distance of each candidate is verified; most candidates fail it.

A value that more than BUCKET fingerprints share (a group of near copies, whatever its size) is not compared pair by pair:
its rows are split by the rest of the fingerprint, whose balls are enumerated in the same way from both sides. Then all that
meet at an entry are within RADIUS of each other, so an entry holds few, and linking them to the smallest loses no link.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from geoloom.llm.common import documents, map_rows, materialize

BITS, SEGMENTS, RADIUS = 64, 2, 2
ALL = (1 << BITS) - 1
#: Fingerprints that may share a segment's value and still be compared one by one.
BUCKET = 32
SHINGLE = 3
SEED = 42


def shingle_digests(text: bytes, n: int) -> np.ndarray:
    """XXH64 of each shingle of n words of a UTF-8 text, in order, with repeats: A-Z lower-cased, ASCII-space separated words.
    Fewer than n words: one shingle of them all. No words: none."""
    import xxhash

    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    starts = (ends + 1 - sizes)[: max(1, len(words) - n + 1)].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[i:j], SEED) for i, j in zip(starts, ends[min(n, len(words)) - 1 :].tolist(), strict=True)], "<u8")


def bit_majority(hashes: np.ndarray) -> int:
    """The number whose bits are set in more than half of the hashes; 0 without any."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprint(text: bytes, n: int = SHINGLE) -> int:
    """The fingerprint of a UTF-8 text over its shingles of n words; no words: 0."""
    return bit_majority(shingle_digests(text, n))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE) -> DataFrame:
    """id and fp (the 64 bits as a signed long) of each whole text. Null and empty texts: 0. One row out for each row in."""

    def start():
        def step(texts):
            found = np.fromiter((fingerprint(t.encode(), n) for t in texts), np.uint64, len(texts))
            return {"fp": found.view(np.int64)}

        return step

    return map_rows(docs, start, [id_col], text_col, "fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def segments(count: int = SEGMENTS) -> list[int]:
    """The masks of count segments, from the lowest bits up."""
    cuts = [BITS * k // count for k in range(count + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)]


def radii(count: int = SEGMENTS, radius: int = RADIUS) -> list[int]:
    """The radius of the ball in each segment. Fingerprints further apart than these in every segment differ by more than
    radius bits, as sum(r + 1) > radius."""
    if not 1 <= count <= radius + 1:
        raise ValueError(f"1 to {radius + 1} segments are of use")
    extra = radius + 1 - count
    return [extra // count + (k < extra % count) for k in reversed(range(count))]


def ball(mask: int, radius: int) -> list[int]:
    """All changes of up to radius of the mask's bits."""
    bits = [1 << b for b in range(BITS) if mask >> b & 1]
    return [reduce(int.__or__, flips, 0) for r in range(radius + 1) for flips in combinations(bits, r)]


def _changed(value: Column, changes: list[int]) -> Column:
    return F.transform(F.array(*[F.lit(_signed(c)) for c in changes]), lambda c: value.bitwiseXOR(c))


def _near(a: Column, b: Column) -> Column:
    """The complete distance of two fingerprints, verified."""
    return F.bit_count(a.bitwiseXOR(b)) <= RADIUS


def tables(distinct: DataFrame, count: int = SEGMENTS, fp_col: str = "fp") -> DataFrame:
    """The segment tables in one: segment, value (the fingerprint's bits in it), fp."""
    fp = F.col(fp_col)
    rows = F.array(*[F.struct(F.lit(k).alias("segment"), fp.bitwiseAND(F.lit(_signed(m))).alias("value")) for k, m in enumerate(segments(count))])
    return distinct.select(F.explode(rows).alias("s"), fp.alias("fp")).select("s.segment", "s.value", "fp")


def probes(table: DataFrame, count: int = SEGMENTS) -> DataFrame:
    """The values at which each fingerprint looks into each segment's table: those of its ball that are not below its own, as
    the other of a pair looks up from below. Columns: segment, value, fp, own."""
    near = F.array().cast("array<bigint>")
    for k, (mask, radius) in reversed(list(enumerate(zip(segments(count), radii(count), strict=True)))):
        near = F.when(F.col("segment") == k, _changed(F.col("value"), ball(mask, radius))).otherwise(near)
    return table.select("segment", F.explode(F.filter(near, lambda v: v >= F.col("value"))).alias("value"), "fp", F.col("value").alias("own"))


def crowded(table: DataFrame) -> DataFrame:
    """segment and value of those that more than BUCKET fingerprints have."""
    return table.groupBy("segment", "value").agg(F.count("*").alias("n")).where(F.col("n") > BUCKET).select("segment", "value")


def candidates(distinct: DataFrame, full: DataFrame, count: int = SEGMENTS) -> DataFrame:
    """Pairs (fp, other) that some segment's table brings together, before their distance is known. The crowded values, full,
    are left to crowded_links()."""
    table = tables(distinct, count)
    held = table.join(full, ["segment", "value"], "left_anti").withColumnRenamed("fp", "other")
    once = (F.col("own") < F.col("value")) | (F.col("fp") < F.col("other"))
    return probes(table, count).join(held, ["segment", "value"]).where(once).select("fp", "other")


def crowded_links(distinct: DataFrame, full: DataFrame, count: int = SEGMENTS) -> DataFrame:
    """Links (a, b) between fingerprints that meet at a crowded value. Its own fingerprints enter the ball of radius 1 in all
    other bits; those that look in from one bit away enter their other bits as they are."""
    met = probes(tables(distinct, count), count).join(full, ["segment", "value"])
    entry = F.array().cast("array<bigint>")
    for k, mask in reversed(list(enumerate(segments(count)))):
        rest = F.col("fp").bitwiseAND(F.lit(_signed(~mask & ALL)))
        entry = F.when(F.col("segment") == k, F.when(F.col("own") == F.col("value"), _changed(rest, ball(~mask & ALL, 1))).otherwise(F.array(rest))).otherwise(entry)
    entries = met.select("fp", "segment", "value", F.explode(entry).alias("entry"))
    least = entries.select("fp", F.min("fp").over(Window.partitionBy("segment", "value", "entry")).alias("least"))
    return least.where((F.col("least") < F.col("fp")) & _near(F.col("fp"), F.col("least"))).select(F.col("least").alias("a"), F.col("fp").alias("b"))


def links(distinct: DataFrame, count: int = SEGMENTS) -> DataFrame:
    """Pairs (a, b), a < b, of fingerprints (column fp, no repeats) within RADIUS bits, enough of them to connect all that are
    linked; some repeat."""
    full = materialize(crowded(tables(distinct, count)), "crowded")
    pairs = candidates(distinct, full, count).where(_near(F.col("fp"), F.col("other")))
    return pairs.select(F.least("fp", "other").alias("a"), F.greatest("fp", "other").alias("b")).unionByName(crowded_links(distinct, full, count))


def stars(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """u and m (the smallest node that can be reached) of every node that isn't the smallest; edges: a and b, any order, repeats.

    Alternates two steps until all components are stars: each node hands its larger neighbours to its smallest one, then its
    smaller neighbours. Each step is a table in the shared folder. Minima are pre-aggregated and written before they are joined:
    adaptive execution splits such plain equi-joins, so a node with very many neighbours needs no task of its own.
    """
    now = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v"), "edges")
    if now.isEmpty():
        return now.select("u", F.col("v").alias("m"))
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"), (F.col("m") < F.col("u")).alias("moved"))
        large = materialize(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("top"), F.max("moved").alias("moved"))
        seen = Observation()
        low = materialize(low.observe(seen, F.count_if(F.col("moved") | (F.col("m") < F.col("top"))).alias("open")).select("u", "m"), "low")
        if not seen.get["open"]:  # nothing was handed on, and no node has two smaller neighbours
            return low
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        now = materialize(small.where("u > v").distinct(), "edges")
    raise RuntimeError("components have not settled")


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node that can be reached) of every node with an edge; edges as in stars()."""
    found = stars(edges)
    return found.select(F.col("u").alias("node"), F.col("m").alias("root")).unionByName(found.select(F.col("m").alias("node"), F.col("m").alias("root")).distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, fingerprint (16 hex digits), component_id (smallest id that can be reached).

    Equal fingerprints are one node, so copies cost one row each and no pairs. Texts without words (null, empty, white
    space) have fingerprint 0 and are linked like any other. Null ids stay as rows and are never a component's id, unless
    the component has no other; repeated rows stay. An empty table gives an empty result; other columns are not read.
    """
    marked = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    classes = materialize(marked.groupBy("fp").agg(F.min(id_col).alias("first")), "classes")
    found = stars(links(classes))
    rooted = classes.join(found, classes["fp"] == found["u"], "left").select("fp", "first", F.coalesce("m", "fp").alias("root"))
    rooted = materialize(rooted, "rooted")
    firsts = materialize(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "firsts")
    table = materialize(rooted.join(firsts, "root").select("fp", "component_id"), "membership")
    return marked.join(table, "fp").select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without near-duplicates: of each component the document with the smallest id stays.

    All columns of docs stay. Rows with a null id stay, as nothing tells them apart; rows of one id are one document and
    stay or go together.
    """
    groups = near_duplicates(docs, id_col, text_col)
    gone = groups.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("__gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["__gone"], "left_anti")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


QUERIES = {"op3_simhash": op3_simhash}
