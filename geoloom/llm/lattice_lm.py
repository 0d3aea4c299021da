"""Language-model scores from a lattice of subwords: the probability of a text, summed over all its segmentations.

A text is a sequence of words and one end; each word is a lattice from its beginning to its stop. Edges are the pieces of an
existing vocabulary: a first piece, which bears the mark of a word's beginning, further pieces, and the stop. A word that the
training texts have is an edge of the same lattice, from beginning to stop, with its count less a discount; what the discounts
free is the weight of the paths over pieces. A forward recursion in log space sums all paths.

The vocabulary's own scores weight the pieces at first. Expected counts over all segmentations (forward-backward) of all
distinct training words, each with the tokens that its discount frees, then set their probabilities, in several rounds. The
edges are proper distributions, so the probabilities of all texts sum to 1.

Counts are joined to texts by chunks of documents, not by documents: each chunk asks once for each of its distinct words.
"""

from __future__ import annotations

import math
import os
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm.common import documents, groups, id_remainder, map_arrow, materialize

MARK = "▁"
#: A chunk of documents is closed beyond so many tokens or distinct words.
CHUNK_TOKENS, CHUNK_WORDS = 8_000_000, 800_000
#: A mark inside a word stands as this symbol, which no piece has.
INNER_MARK = "\ue000"
STOP = -1  # the event that ends a word


@dataclass
class Vocabulary:
    """Pieces of an existing vocabulary. Events: piece ids, byte pieces for characters that no piece spells, and STOP."""

    ids: dict[str, int]
    scores: dict[int, float]
    bytes: list[int]

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lib.get_piece_size()
        spoken = [i for i in range(n) if not (lib.is_unknown(i) or lib.is_control(i) or lib.is_unused(i) or lib.is_byte(i))]
        ids = {p: i for i in spoken if MARK not in (p := lib.id_to_piece(i))[1:]}
        return cls(ids, {i: lib.get_score(i) for i in ids.values()}, [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)])

    def __post_init__(self):
        self.pieces = {i: p for p, i in self.ids.items()}
        self._states()

    def _states(self) -> None:
        """An automaton over symbols: for each prefix of a piece, its number, and the pieces that end there, longest first."""
        number = {"": 0}
        for p in self.ids:
            for k in range(1, len(p) + 1):
                number.setdefault(p[:k], len(number))
        self.number = number
        self.next: list[dict[str, int]] = [{} for _ in number]
        self.ending: list[list[tuple[int, int]]] = [[] for _ in number]
        fall = [0] * len(number)
        for prefix in sorted(number, key=len):
            if not prefix:
                continue
            n, at = number[prefix], 0
            if len(prefix) > 1:
                at = next(number[prefix[k:]] for k in range(1, len(prefix) + 1) if prefix[k:] in number)
            fall[n] = at
            own = [(len(prefix), self.ids[prefix])] if prefix in self.ids else []
            self.ending[n] = own + self.ending[at]
            self.next[number[prefix[:-1]]][prefix[-1]] = n
        self.fall = fall

    def step(self, state: int, symbol: str) -> int:
        """The state after one more symbol."""
        while (found := self.next[state].get(symbol)) is None and state:
            state = self.fall[state]
        return found or 0

    def spelling(self, symbol: str) -> list[int]:
        return [self.bytes[b] for b in (MARK if symbol == INNER_MARK else symbol).encode()]


def log_probabilities(vocabulary: Vocabulary, counts: dict[int, float], prior: float = 0.005) -> dict[int, float]:
    """Natural logarithms of the events' probabilities: those of first pieces sum to 1, those of further pieces, bytes and
    STOP sum to 1. Each event has its count and a share of prior from the vocabulary's own scores, which order its pieces."""
    own = {i: 1 / (10.0 + max(0.0, -s)) for i, s in vocabulary.scores.items()}
    first = {i for p, i in vocabulary.ids.items() if p[0] == MARK}
    out: dict[int, float] = {}
    for side in (first, set(own) - first | set(vocabulary.bytes) | {STOP}):
        least = min(own.values())
        base = {i: own.get(i, least) for i in side}
        if STOP in side:
            base[STOP] = 0.5 * sum(base.values())
        whole = sum(base.values())
        mass = max(1.0, prior * sum(counts.get(i, 0) for i in side))
        total = math.log(sum(counts.get(i, 0) for i in side) + mass)
        out |= {i: math.log(counts.get(i, 0) + mass * base[i] / whole) - total for i in side}
    return out


class Lattice:
    """Passes over the trie of sorted words; what common prefixes share is computed once."""

    def __init__(self, vocabulary: Vocabulary, logs: dict[int, float]):
        self.v, self.logs, self.stop = vocabulary, logs, logs[STOP]
        self.ending = [[(n, logs[i], i) for n, i in e] for e in vocabulary.ending]
        self.single = {p for p in vocabulary.ids if len(p) == 1}
        self.rare: dict[str, tuple[int, float, str]] = {}

    def _edges(self, state: int, symbol: str, first: bool) -> list[tuple]:
        """(symbols, log probability, event) of the edges that end after a symbol; a symbol that is no piece is spelt in bytes."""
        found = self.ending[state]
        if symbol in self.single or first:
            return found
        rare = self.rare.get(symbol)
        if rare is None:
            rare = self.rare[symbol] = (1, sum(self.logs[b] for b in self.v.spelling(symbol)), symbol)
        return [*found, rare]

    def _forward(self, words: list[str], leave):
        """For each sorted word, its place and the log sums of all its prefixes; leave(n) is called before those beyond n go."""
        last, a, states, edges = "", [0.0], [0], [[]]
        log, exp, step = math.log, math.exp, self.v.step
        self.a, self.edges = a, edges
        for k, plain in enumerate(words):
            w = MARK + plain.replace(MARK, INNER_MARK)
            same = len(os.path.commonprefix((last, w)))
            leave(same)
            del a[same + 1 :], states[same + 1 :], edges[same + 1 :]
            for i in range(same + 1, len(w) + 1):
                symbol = w[i - 1]
                state = step(states[-1], symbol)
                found = self._edges(state, symbol, i == 1)
                if len(found) == 1:
                    n, s, _ = found[0]
                    a.append(a[i - n] + s)
                else:
                    paths = [a[i - n] + s for n, s, _ in found]
                    top = max(paths, default=-math.inf)
                    a.append(top + log(sum([exp(x - top) for x in paths])) if top > -math.inf else -math.inf)
                states.append(state)
                edges.append(found)
            last = w
            yield k, a
        leave(0)

    def marginals(self, words: list[str]) -> list[float]:
        """Natural log probability of each sorted word over all segmentations into pieces, stop included."""
        return [a[-1] + self.stop for _, a in self._forward(words, lambda n: None)]

    def expected_counts(self, words: list[str], weights: list[float]) -> dict[int, float]:
        """Expected number of times that each event stands in the segmentations of sorted words, words counted by weights.

        Forward-backward over the trie: the weight that reaches a prefix is handed back over its edges when the walk leaves it,
        for all words below it at once.
        """
        out = dict.fromkeys([*self.v.ids.values(), *self.v.bytes, STOP], 0.0)
        rare: dict[str, float] = {}
        reach = [0.0]
        exp = math.exp

        def leave(to: int) -> None:
            a, edges = self.a, self.edges
            for i in range(len(a) - 1, to, -1):
                mass, here = reach.pop(), a[i]
                for n, s, event in edges[i]:
                    part = mass * exp(a[i - n] + s - here)
                    reach[i - n] += part
                    if isinstance(event, str):
                        rare[event] = rare.get(event, 0.0) + part
                    else:
                        out[event] += part

        for k, a in self._forward(words, leave):
            reach += [0.0] * (len(a) - len(reach))
            reach[-1] += weights[k]
            out[STOP] += weights[k]
        for symbol, n in rare.items():
            for b in self.v.spelling(symbol):
                out[b] += n
        return {event: n for event, n in out.items() if n}


PACKED = "kind string, chunk long, word binary, at int, n long, id {id}, held_out boolean, ids binary"
KINDS = {"kind": pa.string(), "chunk": pa.int64(), "word": pa.binary(), "at": pa.int32(), "n": pa.int64(), "id": None, "held_out": pa.bool_(), "ids": pa.binary()}


def pack(docs: DataFrame, held_out: Column, id_col: str, text_col: str, tasks: int | None = None) -> DataFrame:
    """Chunks of documents, as rows of two kinds: 'doc' has a document's words as compressed numbers, 'word' has what word
    a number stands for in its chunk and how often the chunk's training documents have it. Ids may be of any type.

    The number of a chunk is that of its task and its place there. tasks: read by no more than so many.
    """
    picked = docs.select(F.col(id_col).alias("id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    picked = picked.coalesce(tasks) if tasks else picked

    def run(batches):
        press = zstandard.ZstdCompressor(level=3)
        number: dict[bytes, int] = {}
        count = np.zeros(1024, np.int64)
        chunk, tokens = TaskContext.get().partitionId() << 32, 0

        def rows(kind, size, id_type, **columns):
            made = {"kind": [kind] * size, "chunk": [chunk] * size} | columns
            return pa.RecordBatch.from_arrays([pa.array(made[c], k or id_type) if c in made else pa.nulls(size, k or id_type) for c, k in KINDS.items()], names=list(KINDS))

        def words(id_type):
            order = list(number)
            for at in range(0, len(order), 50_000):
                part = order[at : at + 50_000]
                yield rows("word", len(part), id_type, word=part, at=np.arange(at, at + len(part)), n=count[at : at + len(part)])

        for batch in batches:
            id_type = batch.schema.field(0).type
            for at, many in groups(batch.column(2)):
                part = batch.slice(at, many)
                blobs = []
                for held, text in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    put = number.setdefault
                    ids = np.array([put(w, len(number)) for w in text.encode().lower().split()], np.uint32)
                    if len(number) > len(count):
                        count = np.concatenate([count, np.zeros(len(number), np.int64)])
                    if not held and len(ids):
                        np.add.at(count, ids, 1) if len(ids) < 1000 else np.add(count, np.bincount(ids, minlength=len(count)), out=count)
                    blobs.append(press.compress(ids.tobytes()))
                    tokens += len(ids)
                yield rows("doc", many, id_type, id=part.column(0), held_out=part.column(1), ids=blobs)
                if tokens > CHUNK_TOKENS or len(number) > CHUNK_WORDS:
                    yield from words(id_type)
                    number, count, tokens = {}, np.zeros(1024, np.int64), 0
                    chunk += 1
        if number:
            yield from words(id_type)

    return map_arrow(picked, run, PACKED.format(id=picked.schema["id"].dataType.simpleString()))


#: Rounds of expected counts that set the pieces' probabilities; each is over all distinct training words.
ROUNDS = 3


def _piece_counts(words: DataFrame, shared, mass: Mass) -> dict[int, float]:
    """Expected counts of all distinct training words: summed in each task, then over tasks."""

    def run(batches):
        lattice = Lattice(*shared.value)
        total: dict[int, float] = {}
        for batch in batches:
            weight = dict(zip((w.decode() for w in batch.column(0).to_pylist()), mass.discount(batch.column(1).to_numpy()).tolist(), strict=True))
            order = sorted(weight)
            for event, n in lattice.expected_counts(order, [weight[w] for w in order]).items():
                total[event] = total.get(event, 0.0) + n
        yield pa.RecordBatch.from_arrays([pa.array(list(total.keys()), pa.int64()), pa.array(list(total.values()), pa.float64())], names=["event", "n"])

    sums = map_arrow(words.select("word", "c"), run, "event long, n double").groupBy("event").agg(F.sum("n").alias("n"))
    return {r["event"]: r["n"] for r in sums.collect()}  # no more rows than the vocabulary has pieces


def _learned_counts(words: DataFrame, own: Vocabulary, mass: Mass) -> dict[int, float]:
    """Piece counts after ROUNDS rounds over all words (word, c), the first from the vocabulary's own scores."""
    counts: dict[int, float] = {}
    for _ in range(ROUNDS):
        shared = words.sparkSession.sparkContext.broadcast((own, log_probabilities(own, counts)))  # as large as the vocabulary
        counts = _piece_counts(words, shared, mass)
        shared.unpersist()
    return counts


@dataclass
class Mass:
    """Sums over the training tokens that turn counts into probabilities."""

    tokens: int  # N, ends included
    distinct: int  # V, the end included
    ends: int
    known: int  # distinct words
    times: tuple[int, int, int, int]  # words that occur once, twice, three and four times

    def __post_init__(self):
        n1, n2, n3, n4 = self.times
        if min(self.times):
            y = n1 / (n1 + 2 * n2)
            found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
        else:
            found = (0.5, 0.5, 0.5)
        #: What is taken from the counts of words that occur once, twice, and more often.
        self.discounts = np.array([0.0, *(min(0.95 * k, max(0.1, d)) for k, d in enumerate(found, 1))])
        once, twice = self.times[:2]
        self.freed = float(self.discounts @ [0, once, twice, self.known - once - twice]) + 0.25

    def discount(self, c: np.ndarray) -> np.ndarray:
        return self.discounts[np.minimum(c, 3).astype(np.int64)]

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (self.tokens + 0.5 * (self.distinct + 1)))

    def word(self, c: np.ndarray, spelt: np.ndarray) -> np.ndarray:
        """log10 probability of words: the edge of a word with training count c, and the paths over pieces, whose sum is the
        natural log probability spelt."""
        with np.errstate(divide="ignore"):
            edge = np.log(np.maximum(c - self.discount(c), 0.0))
        return (np.logaddexp(edge, math.log(self.freed) + spelt) - math.log(self.tokens + 0.5)) / math.log(10)

    @property
    def end(self) -> float:
        return math.log10((self.ends + 0.25) / (self.tokens + 0.5))


SCORES = "id {id}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, held_out: Column, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", tasks: int | None = None) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 of its probability).

    Learns from the rows where held_out is false (null counts as false). Null and empty texts are an end alone. Ids may be of
    any type; null ids and repeated rows stay, one row out for each row in; very long texts are one chunk each; an empty table
    gives an empty result; without training rows the pieces' own scores are all there is. Other columns are not read.

    tasks: the texts are read by no more than so many tasks, so that small splits share their chunks' words.
    """
    spark = docs.sparkSession
    packed = materialize(pack(docs, held_out, id_col, text_col, tasks), "packed", "zstd")
    texts = packed.where("kind = 'doc'").select("chunk", "id", "held_out", "ids")
    asked = packed.where("kind = 'word'").select("chunk", "at", "word", "n")
    words = materialize(asked.groupBy("word").agg(F.sum("n").alias("c")).sortWithinPartitions("word"), "words", "zstd")
    times = [F.count_if(F.col("c") == k).alias(f"n{k}") for k in range(1, 5)]
    w = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v"), *times).first()
    ends = texts.where("not held_out").count()
    mass = Mass(w["n"] + ends, w["v"] + (ends > 0), ends, w["v"], (w["n1"], w["n2"], w["n3"], w["n4"]))

    own = Vocabulary.load(vocabulary)
    model = spark.sparkContext.broadcast((own, log_probabilities(own, _learned_counts(words.where("c > 0"), own, mass))))

    def spell(batches):
        lattice = Lattice(*model.value)
        for batch in batches:
            plain = [x.decode() for x in batch.column(0).to_pylist()]
            order = sorted(range(len(plain)), key=plain.__getitem__)
            spelt = np.zeros(len(plain))
            spelt[order] = lattice.marginals([plain[i] for i in order])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(mass.word(batch.column(1).to_numpy(), spelt), pa.float64())], names=["word", "c", "lp"])

    scored = map_arrow(words, spell, "word binary, c long, lp double")
    answers = asked.join(scored, "word").select(F.col("chunk").alias("of_chunk"), "at", "c", "lp")
    schema = SCORES.format(id=packed.schema["id"].dataType.simpleString())
    names = [x.split()[0] for x in schema.split(", ")]

    def finish(_, left, right):
        unpack = zstandard.ZstdDecompressor()
        at = right.column("at").to_numpy()
        c, lp = np.zeros(len(at)), np.zeros(len(at))
        c[at], lp[at] = right.column("c").to_numpy(), right.column("lp").to_numpy()
        base, known = mass.base(c), c > 0
        end = mass.base(np.array([mass.ends]))[0]
        made = []
        for x in left.column("ids").to_pylist():
            ids = np.frombuffer(unpack.decompress(x), np.uint32)
            made.append((len(ids) + 1, int(known[ids].sum()) + (mass.ends > 0), mass.tokens, float(base[ids].sum() + end), float(lp[ids].sum() + mass.end)))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        return pa.Table.from_arrays([left.column("id"), left.column("held_out"), *(pa.array(x, k) for x, k in zip(zip(*made, strict=True), kinds, strict=True))], names=names)

    out = texts.groupBy("chunk").cogroup(answers.groupBy("of_chunk")).applyInArrow(finish, schema)
    return out.withColumnRenamed("id", id_col)


#: Documents whose id has this remainder are held out.
MODULUS, HELD = 5, 1


#: Splits of the input that a task packs together, as long as each core has two tasks.
SPLITS = 8


def op7_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = documents(spark, sf_dir)
    tasks = max(2 * spark.sparkContext.defaultParallelism, docs.rdd.getNumPartitions() // SPLITS)
    return score(docs, id_remainder("doc_id", MODULUS) == HELD, public_tokenizers.path("piece_bpe_32k.model"), tasks=tasks)


QUERIES = {"op7_lattice_lm": op7_lattice_lm}
