"""Contract columns that SQL can say, by DuckDB over whole tables."""

import zlib

import duckdb
import pytest

from geoloom.llm import lattice_lm, media, quality

SF = "/root/testdata/sf0.01"
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

QUALITY = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {WORDS} AS w FROM documents),
lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
again AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
places AS (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) > 4),
windows AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i : i + 4]) AS times FROM places),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM windows, range(5) r(k) WHERE times > 1 GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  coalesce(again.n, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words, len(w) < 10 OR 100 * coalesce(covered.n, 0) > 20 * len(w) AS base_failed
FROM d LEFT JOIN again USING (doc_id) LEFT JOIN covered USING (doc_id)"""

MEDIA = """
SELECT doc_id, strlen(t) AS n_bytes, octet_length(p) AS payload_bytes, sha256(p) AS payload_sha256, crc(p[octet_length(p) - 31 :]) AS tail_crc32
FROM (SELECT doc_id, t, encode(t) || repeat('\\xFF'::BLOB, (CASE WHEN t = '' THEN 576 ELSE -strlen(t) % 576 + CASE WHEN strlen(t) % 576 = 0 THEN 0 ELSE 576 END END)::BIGINT) AS p FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))"""

BASE = f"""
WITH d AS (SELECT doc_id, crc(coalesce(doc_id::VARCHAR, '')::BLOB) % 5 = 1 AS held_out, list_append(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+'), ' ') AS w FROM documents),
tokens AS (SELECT doc_id, held_out, unnest(w) AS token FROM d),
known AS (SELECT token, count(*) AS c FROM tokens WHERE NOT held_out GROUP BY token),
sums AS (SELECT sum(c) AS n, count(*) AS v FROM known)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, any_value(n)::BIGINT AS train_tokens, sum(log10((coalesce(c, 0) + 0.5) / (n + 0.5 * (v + 1)))) AS base_score
FROM tokens LEFT JOIN known USING (token), sums GROUP BY doc_id, held_out"""


def compare(spark, query, sql, places=6):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    db.create_function("crc", lambda x: zlib.crc32(x), ["BLOB"], "BIGINT")
    found = db.execute(sql).fetchall()
    columns = [c[0] for c in db.description]
    row = lambda values: tuple(round(x, places) if isinstance(x, float) else x for x in values)
    got = sorted(row(r) for r in query(spark, SF).select(*columns).collect())
    assert got and got == sorted(map(row, found))


@pytest.mark.parametrize(("query", "sql"), [(quality.op9_quality, QUALITY), (media.op10_media, MEDIA), (lattice_lm.op7_lattice_lm, BASE)], ids=["op9", "op10", "op7"])
def test_contract_columns(spark, query, sql):
    compare(spark, query, sql)
