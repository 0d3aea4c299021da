"""Token counts by prefix dynamic programming over a byte-level vocabulary.

The exact count of every prefix of a text is stored: for each of its bytes by how much the count grows (or falls, as a longer
prefix may need fewer tokens). Truncation and budget questions are sums over the stored steps; no text is encoded again.
"""

from __future__ import annotations

import json
import re
from array import array
from operator import sub

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import LongType, StructField, StructType

from geoloom.llm.common import documents, map_arrow, map_rows, ship_file
from geoloom.llm.prefix_bpe import Bounded, PrefixDP

#: The pattern that cuts texts into words before byte-level merging.
CUT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Texts can be cut before any run of white space that follows another symbol: no word of CUT reaches over that place.
CHUNK = re.compile(rb"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")

#: White space beyond ASCII, and separators on which libraries differ: such texts are cut by CHUNK_ANY.
RARE_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")

CHUNK_ANY = regex.compile(r"\s*\S+|\s+")

#: Words of CUT whose beginnings are cut in two.
SPLIT_BEGINNINGS = (b"'re", b"'ve", b"'ll")

#: The step of a byte that doesn't end a character.
INSIDE = -(1 << 15)


def byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabulary files: printable Latin-1 stands for itself, the rest
    follow from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    table = {chr(b): b for b in plain}
    rest = (b for b in range(256) if b not in set(plain))
    return table | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteCounter:
    """Counts tokens as the library does for one byte-level tokenizer file. Steps: for each byte of a text that ends a character
    by how much the count of the prefix up to there exceeds that of the prefix before, as 16-bit integers; else INSIDE."""

    #: Distinct chunks and words whose steps are kept.
    KEPT, WORDS = 500_000, 700_000

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = byte_symbols()
        raw = lambda t: bytes(back[c] for c in t)
        vocab = {raw(t): i for t, i in spec["model"]["vocab"].items() if all(c in back for c in t)}
        ranks = {}
        for k, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            ranks.setdefault((raw(a), raw(b)), k)
        self.dp = PrefixDP(vocab, lambda a, b: ranks.get((a, b)))
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, self.specials))) if self.specials else None
        self.cut = regex.compile(CUT)
        self.runs = regex.compile(r"\s\s+")
        self.kept, self.known = Bounded(self.KEPT), Bounded(self.WORDS)

    def chunks(self, text: str) -> list[bytes]:
        """Parts of a text that are counted apart; joined they are the text. No word reaches over the places between them, in the
        text or in any of its prefixes."""
        return [c.encode() for c in CHUNK_ANY.findall(text)] if RARE_SPACE.search(text) else CHUNK.findall(text.encode())

    def learn(self, missing: set[bytes]) -> dict[bytes, bytes]:
        """Steps of chunks. Those that are one word after the other are joined from their words' steps."""
        plain, odd, cut = {}, [], self.cut.findall
        for c in missing:
            t = c.decode()
            if t[:2].isspace() or any(x in t for x in self.specials):
                odd.append(c)
            else:
                plain[c] = [w.encode() for w in cut(t)]
        found = self.known.holding(set().union(*plain.values()), self.learn_words).__getitem__
        out = {c: found(ws[0]) if len(ws) == 1 else b"".join(map(found, ws)) for c, ws in plain.items()}
        return out | {c: self._steps(c.decode(), self.prefix_counts(c.decode())) for c in odd}

    def learn_words(self, missing: set[bytes]) -> dict[bytes, bytes]:
        """Steps of words, by one walk over their trie: the walk's counts at every prefix are the word's."""
        out = {}
        for w, _, _, counts in self.dp.walk(sorted(missing)):
            if w in SPLIT_BEGINNINGS:
                counts = [0, 1, 2, counts[-1]]
            if w.isascii():
                out[w] = array("h", map(sub, counts[1:], counts)).tobytes()
            else:
                steps, before = array("h"), 0
                for n, following in zip(counts[1:], w[1:] + b" ", strict=True):
                    if following & 0xC0 == 0x80:  # the character goes on
                        steps.append(INSIDE)
                    else:
                        steps.append(n - before)
                        before = n
                out[w] = steps.tobytes()
        return out

    @staticmethod
    def _steps(text: str, counts: list[int]) -> bytes:
        """Steps from the counts after each character."""
        out, before = array("h"), 0
        for c, n in zip(text, counts, strict=True):
            out.extend([INSIDE] * (len(c.encode()) - 1))
            out.append(n - before)
            before = n
        return out.tobytes()

    def _table(self, word: str) -> list[int]:
        """Counts after each character of one word."""
        raw = word.encode()
        steps = np.frombuffer(self.known.holding({raw}, self.learn_words)[raw], np.int16)
        return np.cumsum(steps[steps != INSIDE], dtype=np.int64).tolist()

    def _plain_counts(self, text: str) -> tuple[list[int], int]:
        """Counts after each character of a text without special tokens, and where its last word begins. A run of white space at the
        end of a prefix is one word, though in the text its last symbol may belong to the next word."""
        out, before, last = [], 0, 0
        for w in self.cut.findall(text):
            last = len(out)
            out += [before + n for n in self._table(w)]
            before = out[-1]
        for m in self.runs.finditer(text):
            base = out[m.start() - 1] if m.start() else 0
            out[m.start() : m.end()] = [base + n for n in self._table(m.group())]
        return out, last

    def prefix_counts(self, text: str) -> list[int]:
        """Token count of each prefix of any text, by characters: the library's count of text[: k + 1] at k.

        The beginning of a special token is ordinary text, which may join the word before it."""
        out, before, at = [], 0, 0
        places = [m.span() for m in self.special.finditer(text)] if self.special else []
        for a, b in [*places, (len(text), len(text))]:
            counts, last = self._plain_counts(text[at:a])
            for k in range(a + 1, b):
                part = self._plain_counts(text[at + last : k])[0]
                counts.append((counts[last - 1] if last else 0) + part[-1])
            whole = counts[a - at - 1] if a > at else 0
            out += [before + n for n in counts]
            before += whole
            if b > a:
                before += 1
                out.append(before)
            at = b
        return out

    def steps(self, texts: list[str]) -> list[np.ndarray]:
        """Steps of whole texts."""
        lists = [self.chunks(t) for t in texts]
        table = self.kept.holding(set().union(*lists), self.learn).__getitem__
        return [np.frombuffer(b"".join(map(table, cs)), np.int16) for cs in lists]


def counts_of(steps: np.ndarray) -> np.ndarray:
    """Token count of the longest prefix of whole characters within each number of bytes, from 1 on."""
    return np.cumsum(np.where(steps == INSIDE, 0, steps), dtype=np.int64)


def total_of(steps: np.ndarray) -> int:
    """Token count of the whole text."""
    return int(steps.sum(dtype=np.int64)) - INSIDE * int(np.count_nonzero(steps == INSIDE))


def longest_within(steps: np.ndarray, limit: int) -> int:
    """Bytes of the longest prefix of whole characters that has at most limit tokens."""
    fits = np.flatnonzero((counts_of(steps) <= limit) & (steps != INSIDE))
    return int(fits[-1]) + 1 if len(fits) else 0


FIELDS = "n_bytes long, n_tokens long, over_limit boolean, fit_bytes long, prefix_steps binary"


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id and FIELDS.

    n_tokens is the library's count without special tokens added. over_limit: more than limit tokens. fit_bytes: bytes of
    the longest prefix of whole characters that keeps to the limit. prefix_steps: the exact counts of all prefixes, as
    compressed steps (see ByteCounter), from which tokens_up_to() and bytes_within() answer any budget.

    Null and empty texts have 0 bytes, 0 tokens and no steps. Null ids, repeated rows and ties are kept as they are, one row
    out for each row in; an empty table gives an empty result; other columns of docs are not read.
    """
    file = ship_file(docs.sparkSession, tokenizer)

    def start():
        counter, press = ByteCounter(file.path()), zstandard.ZstdCompressor(level=1)

        def step(texts):
            found = counter.steps(texts)
            totals = list(map(total_of, found))
            fits = [len(x) if n <= limit else longest_within(x, limit) for x, n in zip(found, totals, strict=True)]
            return {"n_bytes": list(map(len, found)), "n_tokens": totals, "over_limit": [n > limit for n in totals], "fit_bytes": fits, "prefix_steps": [press.compress(x.tobytes()) for x in found]}

        return step

    return map_rows(docs, start, [id_col], text_col, FIELDS)


def _answer(table: DataFrame, name: str, answer) -> DataFrame:
    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            raw = batch.column(batch.schema.get_field_index("prefix_steps")).to_pylist()
            made = [None if x is None else answer(np.frombuffer(unpack.decompress(x), np.int16)) for x in raw]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.int64())], names=[*batch.schema.names, name])

    return map_arrow(table, run, StructType([*table.schema.fields, StructField(name, LongType())]))


def tokens_up_to(table: DataFrame, n_bytes: int) -> DataFrame:
    """table with prefix_count: exact tokens of the longest prefix of whole characters within n_bytes, from the stored steps
    alone. Null where there are no steps (null); an empty table gives an empty result; repeated rows stay. A column of that
    name must not be there yet (ValueError)."""
    if "prefix_count" in table.columns:
        raise ValueError("there is a column prefix_count already")
    return _answer(table, "prefix_count", lambda steps: int(counts_of(steps[:n_bytes])[-1]) if len(steps) and n_bytes > 0 else 0)


def bytes_within(table: DataFrame, limit: int) -> DataFrame:
    """table with prefix_bytes: bytes of the longest prefix of whole characters with at most limit tokens, from the stored steps
    alone. Nulls, empty tables, repeated rows and the column's name as in tokens_up_to()."""
    if "prefix_bytes" in table.columns:
        raise ValueError("there is a column prefix_bytes already")
    return _answer(table, "prefix_bytes", lambda steps: longest_within(steps, limit))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op5_token_counts": op5_token_counts}
