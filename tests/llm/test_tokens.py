import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from geoloom.llm import pieces, token_counts, token_store
from geoloom.llm.common import materialize
from tests.llm.conftest import TEXTS

BYTES, WORDS, PIECES = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))


def library(path):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(path)
    return lambda t: lib.encode(t or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def counter():
    return token_counts.ByteCounter(BYTES)


@pytest.fixture(scope="module")
def codec():
    return pieces.PieceCodec(PIECES)


def expected_count(df, rows):
    return df.count() == rows


def test_counts_are_the_librarys(edge, sample, nothing):
    count = library(BYTES)
    for docs in (edge, sample):
        texts = [(r["doc_id"], len((r["text"] or "").encode()), len(count(r["text"]))) for r in docs.collect()]
        got = token_counts.count_tokens(docs, BYTES).collect()
        assert sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got), key=str) == sorted(texts, key=str)
        assert all(r["over_limit"] == (r["n_tokens"] > 512) for r in got)
    assert token_counts.count_tokens(nothing, BYTES).isEmpty()


def check_prefixes(counter, text):
    """The stored steps against the library, at every byte that ends a character."""
    steps = counter.steps([text])[0]
    assert len(steps) == len(text.encode())
    counts, end = token_counts.counts_of(steps), 0
    inner = set()
    for k, c in enumerate(text):
        inner |= set(range(end, end + len(c.encode()) - 1))
        end += len(c.encode())
        assert counts[end - 1] == len(library_bytes(text[: k + 1])), text[: k + 1]
    assert set(np.flatnonzero(steps == token_counts.INSIDE).tolist()) == inner


@pytest.mark.parametrize("kind", ["counter", "codec"])
def test_which_tokens_may_follow_others(request, kind):
    """Undoing merges tells what merging the joined text tells, for tokens that often meet and for any."""
    dp = request.getfixturevalue(kind).dp
    rng = random.Random(8)
    tokens = [t for t in dp.vocab if len(t) > 0]
    short = [t for t in tokens if len(t) <= 3]
    pairs = [(rng.choice(short), rng.choice(short)) for _ in range(6000)] + [(rng.choice(tokens), rng.choice(tokens)) for _ in range(3000)]
    for t in rng.sample([t for t in tokens if len(t) > 3], 2000):  # two tokens of which one ends as another begins, or that are parts of one
        k = rng.randrange(1, len(t))
        pairs += [(t[:k], t[k:]), (t[k:], t[:k]), (t, t)]
    seen = set()
    for a, b in pairs:
        if a in dp.vocab and b in dp.vocab:
            want = dp.merged(a + b) == [a, b]
            assert dp._may_follow(dp.vocab[a], dp.vocab[b]) == want, (a, b)
            seen.add(want)
    assert seen == {True, False}


@pytest.mark.parametrize("text", [
    "the thereon", " anderes", "aaaaaaaaaaaaaaaaaaaa", "naïve café", "x <|endoftext|> y", "!<|endoftext|><|endoftext|>  a", "<|endoftext", "don't we'll I've they're 'll 're!", "a  b\n\n c\t\t\td   ", "  \n",
    "x\u00a0y\u2028z\u3000w \x1c \x85 q", "日本語 текст 🎉🎉 e\u0301 \u00a0\u00a0 1234 ?!?", "a'ss'tt'LL x''re",
])
def test_every_prefix(counter, text):
    check_prefixes(counter, text)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([" ", "  ", "\n", "\t", "'", "'re", "'ll", "s", "the", "Ünï", "1", "!", "<|", "<|endoftext|>", "\u00a0", "🎉", "e\u0301"]), max_size=12))
def test_every_prefix_of_any_text(counter, parts):
    check_prefixes(counter, "".join(parts))


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60))
def test_any_text(counter, codec, text):
    import sentencepiece

    check_prefixes(counter, text)
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    ids = codec.encode([text])[0]
    assert ids.tolist() == lib.encode(text) and codec.decode(ids) == lib.decode(ids.tolist())


library_bytes = library(BYTES)


def test_budgets_are_answered_from_the_table(spark):
    text = "the thereon é anderes <|endoftext|> don't\u00a0we'll " * 40
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "short")], "doc_id long, text string")
    table = materialize(token_counts.count_tokens(docs, BYTES, limit=100), "table")
    first = table.where("doc_id = 1").first()
    sizes = [len(library_bytes(text[: k + 1])) for k in range(len(text))]
    ends = np.cumsum([len(c.encode()) for c in text])
    assert first["fit_bytes"] == max(e for e, n in zip(ends, sizes, strict=True) if n <= 100) < first["n_bytes"]
    for n_bytes in (0, 1, 100, 777, 10**6):
        got = {r["doc_id"]: r["prefix_count"] for r in token_counts.tokens_up_to(table, n_bytes).collect()}
        assert got[1] == max([0, *(n for e, n in zip(ends, sizes, strict=True) if e == max(ends[ends <= n_bytes], default=0))]) and got[2] == got[3] == 0
    for limit in (0, 1, 57, 10**6):
        got = {r["doc_id"]: r["prefix_bytes"] for r in token_counts.bytes_within(table, limit).collect()}
        assert got[1] == max([0, *(e for e, n in zip(ends, sizes, strict=True) if n <= limit)]) and got[3] == 0
    assert token_counts.tokens_up_to(table.limit(0), 5).isEmpty()
    with pytest.raises(ValueError, match="already"):
        token_counts.tokens_up_to(table.withColumn("prefix_count", F.lit(1)), 5)


def test_small_tables_give_the_same(counter):
    small = token_counts.ByteCounter(BYTES)
    small.kept.most = small.known.most = 5
    texts = [t or "" for t in TEXTS]
    assert [small.steps([t])[0].tolist() for t in texts] == [x.tolist() for x in counter.steps(texts)]


def test_pieces_are_the_librarys(edge, sample, nothing):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for docs in (edge, sample):
        want = [(r["doc_id"], zlib.crc32(np.array(lib.encode(r["text"] or ""), "<u4").tobytes())) for r in docs.collect()]
        got = pieces.encode(docs, PIECES)
        rows = got.collect()
        assert sorted(((r["doc_id"], r["ids_crc32"]) for r in rows), key=str) == sorted(want, key=str)
        assert all(r["round_trip"] for r in rows)
        back = pieces.decode(got, PIECES)
        assert sorted(r["text"] for r in back.collect()) == sorted(r["text"] or "" for r in docs.collect())
    assert pieces.encode(nothing, PIECES).isEmpty()


def test_a_mark_in_the_text_becomes_a_space(spark):
    row = pieces.encode(spark.createDataFrame([(1, "a▁b")], "doc_id long, text string"), PIECES).first()
    assert not row["round_trip"]


def test_store_round_trip(spark, edge, sample, nothing, tmp_path):
    ids = library(WORDS)
    for k, docs in enumerate((edge, sample)):
        store = token_store.write_store(docs, WORDS, 2, f"file://{tmp_path}/{k}", dictionary_bytes=2048, shards=3)
        rows = token_store.read_store(spark, store).collect()
        order = sorted(rows, key=lambda r: r["start"])
        assert [r["doc_id"] for r in order] == sorted((r["doc_id"] for r in docs.collect()), key=lambda i: -1 if i is None else i)
        start = 0
        for r in order:
            assert r["start"] == start
            start += r["n_tokens"]
        want = []
        for r in docs.collect():
            found = [*ids(r["text"]), 2]
            want.append((r["doc_id"], len(found), zlib.crc32(np.array(found, "<u4").tobytes())))
        assert sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows), key=str) == sorted(want, key=str)
        one = token_store.read_documents(spark, store, [4, 5])
        texts = {r["doc_id"]: r["text"] for r in docs.where("doc_id in (4, 5)").collect()}
        assert one == {i: [[*ids(t), 2]] for i, t in texts.items()}
    store = token_store.write_store(nothing, WORDS, 2, f"file://{tmp_path}/none")
    assert token_store.read_store(spark, store).isEmpty()


def test_a_dictionary_is_used_and_checked(spark, sample, tmp_path):
    store = token_store.write_store(sample, WORDS, 2, f"file://{tmp_path}/a", dictionary_bytes=2048)
    sha, raw = token_store.dictionary(spark, store)
    assert len(raw) > 0 and spark.read.parquet(store.blocks).where(F.col("dict_sha256") != sha).isEmpty()
    other = token_store.write_store(sample.limit(0), WORDS, 2, f"file://{tmp_path}/b")
    with pytest.raises(Exception, match="another dictionary"):
        token_store.read_store(spark, token_store.Store(store.blocks, other.dictionary)).collect()


@pytest.mark.parametrize("rows", [1, 40, 189])
def test_every_table_has_a_dictionary(spark, sample, tmp_path, rows):
    ids = library(WORDS)
    docs = sample.orderBy("doc_id").limit(rows)
    store = token_store.write_store(docs, WORDS, 2, f"file://{tmp_path}/{rows}", shards=2)
    sha, raw = token_store.dictionary(spark, store)
    assert raw and {r[0] for r in spark.read.parquet(store.blocks).select("dict_sha256").collect()} == {sha}
    got = {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in token_store.read_store(spark, store).collect()}
    want = {r["doc_id"]: [*ids(r["text"]), 2] for r in docs.collect()}
    assert got == {i: (len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in want.items()}


def test_dictionaries_of_little():
    assert token_store.train_dictionary([], 1024) == b"" and token_store.train_dictionary([b"\2\0"], 1024) == b"\2\0"
    assert token_store.train_dictionary([bytes(range(200))] * 3, 500) == (bytes(range(200)) * 3)[-500:]


def test_the_sample_takes_all_lengths(spark, sample):
    pieces = token_store.sample_pieces(sample, lambda: token_store.WordIds(WORDS, 2), b"\2\0", 1 << 30, "doc_id", "text")
    ids = library(WORDS)
    assert sum(map(len, pieces)) == sum(2 * len(ids(r["text"])) + 2 for r in sample.collect())
    few = token_store.sample_pieces(sample, lambda: token_store.WordIds(WORDS, 2), b"\2\0", 40_000, "doc_id", "text")
    assert 10_000 < sum(map(len, few)) <= 80_000 and set(few) <= set(pieces)
    assert few == token_store.sample_pieces(sample.repartition(3), lambda: token_store.WordIds(WORDS, 2), b"\2\0", 40_000, "doc_id", "text")


def test_text_ids_are_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="whole numbers"):
        token_store.write_store(spark.createDataFrame([("a", "x")], "doc_id string, text string"), WORDS, 2, f"file://{tmp_path}/x")


def test_other_white_space_rules_are_refused():
    with pytest.raises(ValueError, match="white space"):
        token_store.width_of(BYTES)
