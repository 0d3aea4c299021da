"""Quality rules: a linear-chain conditional random field marks lines as content or boilerplate; the content share decides."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm.common import documents, filter_rows, map_rows, picked_by_hash

#: Signs that count as symbols.
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
WINDOW = 5

#: What a line may have. The place in the list is the bit in a line's mask.
FEATURES = (
    "always", "words<=2", "words<=7", "words>=20", "symbols>0", "symbols>=3%", "symbols>=15%", "capitals>=30%", "capitals>=60%", "digits>=10%", "repeats>=30%", "repeats>=60%",
    "short words", "long words", "no lower case", "!", "|", "ends a sentence", "no comma", "seen before", "first", "last", "link or address", "few distinct letters",
)


@dataclass
class Counts:
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int

    @property
    def failed(self) -> bool:
        return self.n_words < 10 or 100 * self.n_repeat_words > 20 * self.n_words


def repeat_words(words: list) -> int:
    """Words that stand in a window of WINDOW words which the text has twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    windows = list(zip(*(words[k:] for k in range(WINDOW)), strict=False))
    if len(set(windows)) == n:
        return 0
    times = Counter(windows)
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.array([i for i, w in enumerate(windows) if times[w] > 1])
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return int((np.cumsum(edge) > 0).sum())


def lines_of(raw: bytes) -> tuple[list[bytes], list[list[bytes]], list[bool]]:
    """The lines that hold a word, their words, and whether the same line came before."""
    lines, words, again, seen = [], [], [], set()
    for line in raw.split(b"\n"):
        if found := line.split():
            lines.append(line)
            words.append(found)
            again.append(line in seen)
            seen.add(line)
    return lines, words, again


def count(text: str, raw: bytes, words: list[list[bytes]], again: list[bool]) -> Counts:
    flat = [w for ws in words for w in ws]
    spaces = len(raw) - len(raw.translate(None, SPACES))
    return Counts(len(flat), len(text) - spaces, len(raw) - len(raw.translate(None, SYMBOLS)), sum(again), repeat_words(flat))


UPPER, LOWER, DIGITS = bytes(range(65, 91)), bytes(range(97, 123)), b"0123456789"


def masks(lines: list[bytes], words: list[list[bytes]], again: list[bool]) -> list[int]:
    """The features of each line, as bits."""
    out, top = [], len(lines) - 1
    for k, (line, ws, seen) in enumerate(zip(lines, words, again, strict=True)):
        n, size = len(ws), len(line)
        left = lambda drop: size - len(line.translate(None, drop))  # noqa: B023, E731
        symbols, capitals, digits, distinct = left(SYMBOLS), left(UPPER), left(DIGITS), len(set(ws))
        small = left(LOWER)
        letters = max(1, capitals + small)
        mean = (size - n + 1) / n
        have = (
            True, n <= 2, n <= 7, n >= 20, symbols > 0, 100 * symbols >= 3 * size, 100 * symbols >= 15 * size, 10 * capitals >= 3 * letters and capitals > 2, 10 * capitals >= 6 * letters and capitals > 2,
            10 * digits >= size, 10 * (n - distinct) >= 3 * n and n > 4, 10 * (n - distinct) >= 6 * n and n > 4, mean < 3, mean > 10, not small, b"!" in line, b"|" in line, line.rstrip()[-1:] in b".?!",
            b"," not in line, seen, not k, k == top, b"://" in line or b"@" in line or b"www." in line, len(set(line)) < 8,
        )
        out.append(sum(1 << i for i, x in enumerate(have) if x))
    return out


@dataclass
class Crf:
    """Weights of a chain of two labels: 0 boilerplate, 1 content."""

    emit: np.ndarray  # (2, features)
    step: np.ndarray  # (2, 2), from and to
    begin: np.ndarray  # (2,)

    def __post_init__(self):
        self._known: dict[int, tuple[float, float]] = {}

    def scores(self, mask: int) -> tuple[float, float]:
        found = self._known.get(mask)
        if found is None:
            bits = [i for i in range(len(FEATURES)) if mask >> i & 1]
            found = self._known[mask] = tuple(self.emit[:, bits].sum(axis=1).tolist())
        return found

    def decode(self, found: list[int]) -> list[int]:
        """The best labels of a document's lines, by Viterbi's algorithm; on a tie, content."""
        (t00, t01), (t10, t11) = self.step.tolist()
        back = []
        for k, mask in enumerate(found):
            e0, e1 = self.scores(mask)
            if not k:
                a0, a1 = self.begin[0] + e0, self.begin[1] + e1
                continue
            from0, from1 = a1 + t10 >= a0 + t00, a1 + t11 >= a0 + t01
            a0, a1 = (a1 + t10 if from0 else a0 + t00) + e0, (a1 + t11 if from1 else a0 + t01) + e1
            back.append((from0, from1))
        if not found:
            return []
        labels = [int(a1 >= a0)]
        for step in reversed(back):
            labels.append(int(step[labels[-1]]))
        return labels[::-1]


#: Keeps everything: what there is without labelled documents of both kinds.
LENIENT = Crf(np.array([[0.0] * len(FEATURES), [1.0, *[0.0] * (len(FEATURES) - 1)]]), np.zeros((2, 2)), np.zeros(2))


def fit(examples: list[tuple[list[int], int]], rounds: int = 120, rate: float = 0.1, penalty: float = 2.0) -> Crf:
    """The weights of greatest penalised likelihood, by full-batch gradient steps (Adam) with forward-backward sums.

    examples: (masks of a document's lines, label of them all). Each label counts for half of the whole.
    """
    examples = sorted((x for x in examples if x[0]), key=lambda x: -len(x[0]))
    kinds = Counter(y for _, y in examples)
    if len(kinds) < 2:
        return LENIENT
    sizes = np.array([len(m) for m, _ in examples])
    gold = np.array([y for _, y in examples])
    share = np.array([len(examples) / 2 / kinds[y] for y in gold])
    unique, inverse = np.unique(np.concatenate([m for m, _ in examples]), return_inverse=True)
    bits = (unique[:, None] >> np.arange(len(FEATURES)) & 1).astype(float)
    starts = np.cumsum(sizes) - sizes
    longest, n = int(sizes[0]), len(examples)
    index = np.zeros((longest, n), np.int64)
    live = [int((sizes > t).sum()) for t in range(longest)]  # the documents that have a line t come first
    for t in range(longest):
        index[t, : live[t]] = inverse[starts[: live[t]] + t]

    width = len(FEATURES)
    w = np.zeros(2 * width + 4 + 2)
    m, v = np.zeros_like(w), np.zeros_like(w)
    parts = lambda x: (x[: 2 * width].reshape(2, width), x[2 * width : 2 * width + 4].reshape(2, 2), x[-2:])
    real = np.zeros_like(w)
    emit_g, step_g, begin_g = parts(real)
    weight = np.zeros((2, len(unique)))
    for y in (0, 1):
        np.add.at(weight[y], inverse, np.repeat(share * (gold == y), sizes))
        emit_g[y] = weight[y] @ bits
        step_g[y, y] = (share * (gold == y) * (sizes - 1)).sum()
        begin_g[y] = (share * (gold == y)).sum()
    for k in range(1, rounds + 1):
        emit, step, begin = parts(w)
        score = bits @ emit.T
        alpha = np.zeros((longest, n, 2))
        alpha[0] = begin + score[index[0]]
        for t in range(1, longest):
            a = alpha[t - 1, : live[t]]
            alpha[t, : live[t]] = np.logaddexp(a[:, :1] + step[0], a[:, 1:] + step[1]) + score[index[t, : live[t]]]
        total = np.array([np.logaddexp(*alpha[s - 1, i]) for i, s in enumerate(sizes)])
        wants = np.zeros_like(w)
        emit_w, step_w, begin_w = parts(wants)
        seen = np.zeros((2, len(unique)))
        beta = np.zeros((n, 2))
        for t in range(longest - 1, -1, -1):
            now = live[t]
            p = np.exp(alpha[t, :now] + beta[:now] - total[:now, None]) * share[:now, None]
            for y in (0, 1):
                seen[y] += np.bincount(index[t, :now], p[:, y], len(unique))
            if not t:
                begin_w += p.sum(axis=0)
                break
            ahead = score[index[t, :now]] + beta[:now]
            a = alpha[t - 1, :now]
            for x in (0, 1):
                for y in (0, 1):
                    step_w[x, y] += (np.exp(a[:, x] + step[x, y] + ahead[:, y] - total[:now]) * share[:now]).sum()
            beta[:now] = np.stack([np.logaddexp(step[x, 0] + ahead[:, 0], step[x, 1] + ahead[:, 1]) for x in (0, 1)], axis=1)
        emit_w += seen @ bits
        g = (real - wants - penalty * w) / n
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w + rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    emit, step, begin = parts(w)
    return Crf(emit.copy(), step.copy(), begin.copy())


def train(docs: DataFrame, labels: DataFrame, per_class: int = 600, run_lines: int = 300, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Crf:
    """A model from a bounded sample: about per_class labelled documents of each label, at most twice as many, picked by a
    hash of their ids, and of their lines at most 4 * per_class runs of up to run_lines lines. A document's label is its lines'
    label; longer documents give several runs.

    Ids may be of any type. Labels repeat or are null at will; an id that has both labels has none. Rows of one id are
    documents of their own. Without both labels, or without their documents, the model keeps everything (LENIENT).
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.min(label_col).alias("__label"), F.max(label_col).alias("__most"))
    known = known.where("__label = __most").select("__id", "__label")
    sizes = {r["__label"]: r["n"] for r in known.groupBy("__label").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return LENIENT
    part = F.coalesce(*[F.when(F.col("__label") == y, F.lit(min(1.0, per_class / n))) for y, n in sizes.items()])
    order = F.xxhash64(F.lit("quality"), "__id")
    picked = known.where(picked_by_hash("quality", "__id", share=part)).orderBy(order, "__id").limit(4 * per_class)
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__body")).join(F.broadcast(picked), "__id")  # bounded by the limit above

    def start():
        return lambda texts: {"masks": [masks(*lines_of(t.encode())) for t in texts]}

    found = map_rows(rows, start, ["__id", "__label"], "__body", "masks array<int>").where(F.size("masks") > 0)
    starts = F.sequence(F.lit(1), F.size("masks"), F.lit(run_lines))
    runs = found.select("__id", "__label", "masks", F.explode(starts).alias("__at"))
    runs = runs.select("__id", "__label", "__at", F.slice("masks", F.col("__at"), F.lit(run_lines)).alias("masks"))
    rows = runs.orderBy(F.xxhash64(F.lit("run"), "__id", "__at"), "__id", "__at", "masks").limit(4 * per_class).collect()
    return fit([(list(r["masks"]), int(r["__label"])) for r in rows])


#: A document is kept if at least this share of its words stands in lines of content.
LEAST_SHARE = 0.5


def judge_text(text: str, model: Crf) -> tuple[Counts, float, bool]:
    """(counts, content share, kept)."""
    raw = text.encode()
    lines, words, again = lines_of(raw)
    counts = count(text, raw, words, again)
    labels = model.decode(masks(lines, words, again))
    share = sum(len(ws) for ws, y in zip(words, labels, strict=True) if y) / counts.n_words if counts.n_words else 0.0
    return counts, share, not counts.failed and share >= LEAST_SHARE


FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double"


def assess(docs: DataFrame, model: Crf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id and FIELDS.

    Null and empty texts have no words: base_failed, not kept, content share 0. Null ids and repeated rows stay, one row
    out for each row in; an empty table gives an empty result; other columns are not read.
    """

    def start():
        def step(texts):
            found = [judge_text(t, model) for t in texts]
            out = {k: [getattr(c, k) for c, _, _ in found] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
            return out | {"base_failed": [c.failed for c, _, _ in found], "kept": [k for _, _, k in found], "content_share": [s for _, s, _ in found]}

        return step

    return map_rows(docs, start, [id_col], text_col, FIELDS)


def keep_good(docs: DataFrame, model: Crf, text_col: str = "text") -> DataFrame:
    """The rows of docs that are kept, with all their columns. Null and empty texts go; repeated rows stay or go together; an
    empty table gives an empty result."""

    def start():
        return lambda texts: [judge_text(t, model)[2] for t in texts]

    return filter_rows(docs, start, text_col)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return assess(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


QUERIES = {"op9_quality": op9_quality}
