"""SentencePiece encoding and decoding: forward scores over a trie of marked words, shared between common prefixes."""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from geoloom.llm.common import documents, map_arrow, map_rows, ship_file
from geoloom.llm.prefix_bpe import Bounded, PrefixDP

MARK = "▁"  # stands for a space


class PieceCodec:
    """Encodes and decodes as the library does, for a piece vocabulary whose scores order merges.

    For such vocabularies the best path through the lattice is the one that the merges leave: the forward pass gives each
    prefix its one admissible last piece, its back pointer and its path length (see PrefixDP), and the path is read off
    backwards, as in Viterbi decoding. Distinct marked words are sorted into a trie and walked depth-first.
    """

    #: Distinct words, and parts of words, whose ids are kept.
    KEPT, STEMS = 600_000, 700_000

    def __init__(self, model: str):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=model)
        n = lib.get_piece_size()
        special = {i for i in range(n) if lib.is_unknown(i) or lib.is_control(i) or lib.is_unused(i) or lib.is_byte(i)}
        vocab = {lib.id_to_piece(i): i for i in range(n) if i not in special}
        score = {p: -lib.get_score(i) for p, i in vocab.items()}
        if any(MARK in p.lstrip(MARK) for p in vocab):
            raise ValueError("a piece reaches over a space; words can't be encoded apart")
        shared = frozenset(s for s, n in Counter(score.values()).items() if n > 1)
        self.dp = PrefixDP(vocab, lambda a, b: score.get(a + b), shared)
        self.unknown = lib.unk_id()
        self.bytes = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.fallback = all(lib.is_byte(i) for i in self.bytes)
        alone = [c for c in "\n\t|" if not any(c in p and p != c for p in vocab)]  # no piece joins these with others
        out = "".join(map(re.escape, alone))
        self.cut = re.compile(f"{MARK}+[^{MARK}{out}]*|[^{MARK}{out}]+" + f"|[{out}]" * bool(out))
        ends = "".join(c for c in ".,|!?%$#&*;:" if not any(a.isalpha() and b == c for p in vocab for a, b in zip(p, p[1:], strict=False)))
        self.stem = re.compile(f"({MARK}*[^\\W\\d_{MARK}]+)([{ends}]+)") if ends else None  # no piece reaches from a letter to such an end
        self.spelt = [lib.id_to_piece(i).replace(MARK, " ").encode() if i not in special else b"" for i in range(n)]
        for b, i in enumerate(self.bytes):
            if self.fallback:
                self.spelt[i] = bytes([b])
        self.spelt[self.unknown] = " ⁇ ".encode()
        self.kept, self.stems = Bounded(self.KEPT), Bounded(self.STEMS)
        self.code = "H" if n <= 1 << 16 else "I"
        self.kind = np.dtype(self.code)

    def words(self, text: str) -> list[str]:
        """Marked words; joined they are the text after one leading mark."""
        return self.cut.findall(MARK + text.replace(" ", MARK)) if text else []

    def learn(self, missing: set[str]) -> dict[str, bytes]:
        """Ids of words. Letters and the signs after them are looked up apart where no piece holds both."""
        parts = {w: m.groups() if self.stem and (m := self.stem.fullmatch(w)) else (w,) for w in missing}
        found = self.stems.holding(set().union(*parts.values()), self.learn_stems).__getitem__
        return {w: b"".join(map(found, ps)) for w, ps in parts.items()}

    def learn_stems(self, missing: set[str]) -> dict[str, bytes]:
        """Ids of parts of words, by one walk over their trie."""
        out = {}
        for w, ids, starts, _ in self.dp.walk(sorted(missing)):
            found = self.dp.path(ids, starts)
            if min(found) < 0:
                found = [i for k in found for i in (self._spell(k) if k < 0 else (k,))]
            out[w] = array(self.code, found).tobytes()
        return out

    def _spell(self, unknown: int) -> list[int]:
        symbol = self.dp.text_of[unknown]
        return [self.bytes[b] for b in symbol.encode()] if self.fallback else [self.unknown]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        lists = [self.words(t) for t in texts]
        table = self.kept.holding(set().union(*lists), self.learn)
        return [np.frombuffer(b"".join(map(table.__getitem__, ws)), self.kind).astype("<u4") for ws in lists]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; the leading space that encoding adds goes."""
        raw = b"".join(map(self.spelt.__getitem__, ids.tolist()))
        return raw[raw[:1] == b" " :].decode(errors="replace")


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_tokens, ids (little-endian unsigned 32-bit integers), ids_crc32, round_trip.

    ids are those of the library for the whole text, without begin or end. round_trip: decoding the ids gave the text
    again. Null and empty texts have no ids; characters outside the vocabulary are spelt in byte pieces; a text that holds
    the mark itself decodes to a space there. Null ids and repeated rows stay, one row out for each row in; an empty table
    gives an empty result; other columns are not read.
    """

    file = ship_file(docs.sparkSession, model)

    def start():
        codec = PieceCodec(file.path())

        def step(texts):
            found = codec.encode(texts)
            raw = [a.tobytes() for a in found]
            back = [codec.decode(a) for a in found]
            return {"n_tokens": list(map(len, found)), "ids": raw, "ids_crc32": list(map(zlib.crc32, raw)), "round_trip": [a == b for a, b in zip(texts, back, strict=True)]}

        return step

    return map_rows(docs, start, [id_col], text_col, "n_tokens long, ids binary, ids_crc32 long, round_trip boolean")


def decode(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and text of each row of ids, as encode() gives them. Null ids give a null text."""
    import pyarrow as pa

    picked = encoded.select(id_col, ids_col)
    file = ship_file(encoded.sparkSession, model)

    def run(batches):
        codec = None
        for batch in batches:
            codec = codec or PieceCodec(file.path())
            texts = [None if x is None else codec.decode(np.frombuffer(x, "<u4")) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return map_arrow(picked, run, picked.select(id_col).schema.add("text", "string"))


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(documents(spark, sf_dir), model_path()).drop("ids")


QUERIES = {"op4_sentencepiece": op4_sentencepiece}
