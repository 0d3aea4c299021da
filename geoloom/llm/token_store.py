"""Token ids in compressed files: one shared dictionary, one frame for each document, an index for single reads.

Format, version 1. A store is a Parquet table whose rows are blocks. A block's data holds the zstandard frames of its
documents one after the other; each frame is one document's ids, as little-endian unsigned integers of width bytes. All
frames use the dictionary that row 0 of the dictionary table holds and whose SHA-256 each block repeats. The index arrays
of a block give, for each of its documents in order, the id, the frame's offset in data, and the number of ids before it in
the shard. Shards follow each other in the order of their numbers, and documents are in ascending order of their ids.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm.common import documents, groups, map_arrow, picked_by_hash, shared_dir, ship_file, written
from geoloom.llm.prefix_bpe import Bounded

BLOCK = "shard int, block int, dict_sha256 string, width int, data binary, doc_ids array<bigint>, offsets array<bigint>, befores array<bigint>, n_ids bigint"
#: Bytes of compressed frames in a block.
BLOCK_BYTES = 1 << 20
#: The library's own default.
LEVEL = 3


class WordIds:
    """Ids of whole texts by the library, for tokenizers that drop white space: what lies between it is encoded apart and kept.

    Only what is new goes to the library, many words in one call. The ids of a call are dealt back to its words by the
    word-end mark that the last token of each word bears. Texts whose letters lower-case and compose one by one are
    lower-cased first and get a space before each run of signs, where the library cuts anyway: that leaves fewer words.
    """

    KEPT = 700_000
    #: Words in one call.
    CALL = 500
    #: Texts with one of these, or beyond Latin-1, go to the library as they are: spaces and separators that libraries see differently.
    ODD = b"\x1c\x1d\x1e\x1f\x85\xa0"
    SIGNS = re.compile("[" + "".join(re.escape(c) for c in map(chr, range(0x100)) if not c.isalnum() and not c.isspace()) + "]+")

    def __init__(self, path: str, width: int):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.kind = np.dtype(f"<u{width}")
        self.kept = Bounded(self.KEPT)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, mark = spec["model"], spec["model"]["end_of_word_suffix"]
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.ends = np.zeros(max(model["vocab"].values()) + 1, bool)
        self.ends[[i for t, i in model["vocab"].items() if mark and t.endswith(mark)]] = True

    def simple(self, text: str) -> bool:
        try:
            raw = text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        return len(raw.translate(None, self.ODD)) == len(raw)

    def words(self, text: str) -> list[bytes]:
        """Parts of a text that are encoded apart."""
        if self.simple(text) and not any(t in text for t in self.special):
            return self.SIGNS.sub(r" \g<0>", text.lower()).encode().split()
        return text.encode().split()

    def learn(self, missing: set[bytes]) -> dict[bytes, bytes]:
        plain, odd = [], []
        for w in missing:
            t = w.decode()
            (plain if t.isalpha() and (t.isascii() or self.simple(t)) else odd).append(t)
        found = self.lib.encode_batch_fast(odd, add_special_tokens=False)
        out = {w.encode(): np.array(e.ids, self.kind).tobytes() for w, e in zip(odd, found, strict=True)}
        return out | {w.encode(): ids for w, ids in self.learn_stems(plain).items()}

    def learn_stems(self, order: list[str]) -> dict[str, bytes]:
        """Ids of words of letters alone, which are one word to the library."""
        out, size = {}, self.kind.itemsize
        calls = [order[i : i + self.CALL] for i in range(0, len(order), self.CALL)]
        for words, e in zip(calls, self.lib.encode_batch_fast(list(map(" ".join, calls)), add_special_tokens=False), strict=True):
            ids = np.array(e.ids, self.kind)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(words):  # a word that isn't one word after all
                out |= {w: np.array(self.lib.encode(w, add_special_tokens=False).ids, self.kind).tobytes() for w in words}
                continue
            raw, at = ids.tobytes(), 0
            for w, to in zip(words, (cuts * size).tolist(), strict=True):
                out[w] = raw[at:to]
                at = to
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        lists = list(map(self.words, texts))
        table = self.kept.holding(set().union(*lists), self.learn)
        return [b"".join(map(table.__getitem__, ws)) for ws in lists]


@lru_cache(maxsize=1)
def word_ids(path: str, width: int) -> WordIds:
    """One tokenizer, with what it has learned, for all tasks that a worker does one after the other."""
    return WordIds(path, width)


def width_of(path: str) -> int:
    """Bytes that each id needs. Also makes sure that the tokenizer drops white space, on which WordIds rests."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
    if not (steps and steps[0].get("invert") and steps[0]["behavior"] == "Removed" and "\\s" in steps[0]["pattern"]["Regex"]):
        raise ValueError("this tokenizer doesn't drop white space between words")
    top = max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])])
    return 2 if top < 1 << 16 else 4


@dataclass
class Store:
    """Paths of the two tables of a store."""

    blocks: str
    dictionary: str


#: Bytes of ids in a piece of the sample for the dictionary, how much more text is encoded than the sample takes, and by how many
#: tasks: the sample is bounded, and each task loads the tokenizer.
PIECE_BYTES, SPREAD, SAMPLERS = 2048, 2, 6


def sample_pieces(docs: DataFrame, coder: Callable[[], WordIds], end: bytes, most_bytes: int, id_col: str, text_col: str) -> list[bytes]:
    """About most_bytes of serialized ids, at most twice as many, as pieces of up to PIECE_BYTES from documents of all lengths.

    Documents, then pieces of them, are picked by hashes, so that each piece of the table has the same chance. The documents
    are encoded in tasks. A null id counts as any other; repeated rows may give a piece more than once; an empty table
    gives none.
    """
    size = F.length(F.coalesce(F.col(text_col), F.lit(""))) + 1  # ids take about as many bytes as half the characters
    total = docs.agg(F.sum(size).alias("n")).first()["n"]
    if not total:
        return []
    share = min(1.0, 2 * most_bytes / total)
    some = min(1.0, SPREAD * share)
    picked = docs.where(picked_by_hash("dictionary", id_col, share=some)).select(F.xxhash64(F.lit("piece"), id_col).alias("place"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    picked = picked.repartition(SAMPLERS)

    def run(batches):
        words = coder()
        for batch in batches:
            for at, many in groups(batch.column(1)):
                part = batch.slice(at, many)
                places, pieces = [], []
                for place, ids in zip(part.column(0).to_pylist(), words.encode(part.column(1).to_pylist()), strict=True):
                    ids += end
                    for k in range(0, len(ids), PIECE_BYTES):
                        pieces.append(ids[k : k + PIECE_BYTES])
                        places.append(place ^ k)
                yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), pa.array(pieces, pa.binary())], names=["place", "piece"])

    pieces = map_arrow(picked, run, "place long, piece binary").where(picked_by_hash("piece", "place", share=share / some))
    rows = pieces.orderBy(F.xxhash64("place"), "piece").limit(max(1, 2 * most_bytes // PIECE_BYTES)).collect()
    return [bytes(r["piece"]) for r in rows]


def train_dictionary(samples: list[bytes], size: int) -> bytes:
    """A zstandard dictionary of up to size bytes, a tenth of the samples at most. Samples that are too few or too alike to train
    on are the dictionary themselves, as raw content, which the library takes as well. No samples: none (empty)."""
    whole = sum(map(len, samples))
    try:
        return zstandard.train_dictionary(max(256, min(size, whole // 10)), samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def write_store(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    dictionary_bytes: int = 64 << 10,
    sample_bytes: int = 2 << 20,
    shards: int | None = None,
) -> Store:
    """Encode whole texts, append end_id to each, and write the store under path, in ascending order of the ids.

    The dictionary has up to dictionary_bytes, trained on a bounded sample of about sample_bytes of serialized ids from texts
    of all lengths; it changes the size of the files, never what they hold. Every table with a row has one. Ids must be
    whole numbers (ValueError for other types). Null texts count as empty and keep their end id. Null ids come first. Rows of
    the same id stay apart, in an order fixed by their texts. An empty table gives an empty store. Other columns are not read.
    """
    if docs.schema[id_col].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise ValueError(f"the store's index holds whole numbers; {id_col} is {docs.schema[id_col].dataType.simpleString()}")
    spark = docs.sparkSession
    width = width_of(tokenizer)
    kind = np.dtype(f"<u{width}")
    end = np.array([end_id], kind).tobytes()
    file = ship_file(spark, tokenizer)
    raw = train_dictionary(sample_pieces(docs, lambda: word_ids(file.path(), width), end, sample_bytes, id_col, text_col), dictionary_bytes)
    sha = hashlib.sha256(raw).hexdigest()
    store = Store(f"{path}/blocks", f"{path}/dictionary")
    spark.createDataFrame([(sha, bytearray(raw))], "dict_sha256 string, dictionary binary").coalesce(1).write.parquet(store.dictionary)

    n = shards or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.repartitionByRange(n, "id", F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"))

    def run(batches):
        shard, block, before = TaskContext.get().partitionId(), 0, 0
        coder = word_ids(file.path(), width)
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(raw))
        data, ids, offsets, befores = bytearray(), [], [], []

        def flush():
            out = [[shard], [block], [sha], [width], [bytes(data)], [ids], [offsets], [befores], [before - (befores[0] if befores else 0)]]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, KINDS, strict=True)], names=NAMES)

        for batch in batches:
            for at, many in groups(batch.column(1)):
                part = batch.slice(at, many)
                for i, got in zip(part.column(0).to_pylist(), coder.encode(part.column(1).to_pylist()), strict=True):
                    offsets.append(len(data))
                    befores.append(before)
                    ids.append(i)
                    data += press.compress(got + end)
                    before += len(got) // width + 1
                    if len(data) >= BLOCK_BYTES:
                        yield flush()
                        block += 1
                        data, ids, offsets, befores = bytearray(), [], [], []
        if ids:
            yield flush()

    map_arrow(rows, run, BLOCK).write.option("compression", "none").parquet(store.blocks)
    return store


NAMES = [x.split()[0] for x in BLOCK.split(", ")]
KINDS = [pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64()]


def dictionary(spark: SparkSession, store: Store) -> tuple[str, bytes]:
    """Hash and bytes of a store's dictionary; an error if they don't fit each other."""
    row = spark.read.parquet(store.dictionary).first()
    raw = bytes(row["dictionary"])
    if hashlib.sha256(raw).hexdigest() != row["dict_sha256"]:
        raise ValueError("the dictionary doesn't have the hash that it states")
    return row["dict_sha256"], raw


def opener(sha: str, raw: bytes) -> Callable:
    """A function of (a block's dict_sha256, width, frame) that returns the ids."""
    unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))

    def ids(stated: str, width: int, frame: bytes) -> np.ndarray:
        if stated != sha:
            raise ValueError("the block was written with another dictionary")
        return np.frombuffer(unpack.decompress(frame), f"<u{width}").astype("<u4")

    return ids


def read_store(spark: SparkSession, store: Store) -> DataFrame:
    """One row per stored document: doc_id, shard, start (ids of all documents before it), n_tokens, ids_crc32. Null ids and rows
    of one id are rows of their own, as they were written; an empty store gives no rows."""
    sha, raw = dictionary(spark, store)
    blocks = spark.read.schema(BLOCK).parquet(store.blocks)
    # One row for each shard: as many as the store was written with, not as many as there are documents.
    totals = sorted((r["shard"], r["n"]) for r in blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect())
    starts, total = {}, 0
    for shard, n in totals:
        starts[shard], total = total, total + n

    def run(batches):
        ids = opener(sha, raw)
        for batch in batches:
            for b in batch.to_pylist():
                cuts = [*b["offsets"], len(b["data"])]
                found = [ids(b["dict_sha256"], b["width"], b["data"][i:j]) for i, j in zip(cuts, cuts[1:], strict=False)]
                first = starts[b["shard"]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(b["doc_ids"], pa.int64()), pa.array([b["shard"]] * len(found), pa.int32()), pa.array([first + x for x in b["befores"]], pa.int64()), pa.array(list(map(len, found)), pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in found], pa.int64())],
                    names=["doc_id", "shard", "start", "n_tokens", "ids_crc32"],
                )

    return map_arrow(blocks, run, "doc_id long, shard int, start long, n_tokens long, ids_crc32 long")


def read_documents(spark: SparkSession, store: Store, wanted: list[int]) -> dict[int, list[list[int]]]:
    """Ids of a few documents: their blocks are found by the index, and only their own frames are opened. An id that several rows
    have gives several lists; one that none has, or an empty store, gives none."""
    sha, raw = dictionary(spark, store)
    hit = F.arrays_overlap("doc_ids", F.array(*[F.lit(int(w)).cast("long") for w in wanted]))
    one = F.explode(F.arrays_zip("doc_ids", "offsets", F.concat(F.slice("offsets", F.lit(2), F.size("offsets")), F.array(F.length("data").cast("long"))).alias("ends")))
    rows = spark.read.schema(BLOCK).parquet(store.blocks).where(hit).select("dict_sha256", "width", "data", one.alias("x")).where(F.col("x.doc_ids").isin(wanted))
    frame = F.expr("substring(data, cast(x.offsets + 1 as int), cast(x.ends - x.offsets as int))")
    ids, out = opener(sha, raw), {}
    for r in rows.select("dict_sha256", "width", frame.alias("frame"), F.col("x.doc_ids").alias("id")).collect():
        out.setdefault(r["id"], []).append(ids(r["dict_sha256"], r["width"], bytes(r["frame"])).tolist())
    return out


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    import public_tokenizers

    path = f"{shared_dir(spark)}/token-store-{uuid.uuid4().hex}"
    written(path)
    store = write_store(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), 2, path)
    return read_store(spark, store).select("doc_id", "start", "n_tokens", "ids_crc32")


QUERIES = {"op8_token_store": op8_token_store}
