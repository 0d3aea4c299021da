import pytest

LONG = "the Thereon ereing, was. " * 4000
TEXTS = [
    "Of the anderes in thation. The onther.\nOf the anderes in thation.",
    None,
    "",
    " \t\n ",
    "a",
    "a b",
    LONG,
    LONG,
    "Ünïcödé façade — 日本語 текст 🎉🎉 a|b #x# 50%",
    "<|endoftext|> special <s> </s> <unk>  spaces   here\r\nnew\x0bline\x00end",
    "don't we'll I've 123 4567 !!! ???",
    "x\u00a0y\u2028z\u3000w \x1c \x85 q",
]


@pytest.fixture(scope="session")
def edge(spark):
    """Documents with nulls in any column, odd texts, ties, repeated rows, and columns whose names operators use for results."""
    rows = [(i, t, "en" if i % 3 else None, "src0" if i % 2 else None, len(t or ""), "mine", 1, False) for i, t in enumerate(TEXTS)]
    rows += [rows[0], rows[0], (None, TEXTS[0], None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, n_tokens long, kept boolean").repartition(3)


@pytest.fixture(scope="session")
def nothing(edge):
    return edge.limit(0)


@pytest.fixture(scope="session")
def sample(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def by_id(rows):
    out = {}
    for r in rows:
        out.setdefault(r["doc_id"], []).append(r)
    return out
