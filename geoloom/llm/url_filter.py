"""URL rules by hashed expressions: host suffixes and path prefixes, short hash prefixes, full digests, rule precedence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A rule table of up to so many rows is sent to every executor; a larger one is joined by a salted shuffle.
BROADCAST_RULES = 200_000
SALTS = 32
#: Hex digits of the digest that the join compares; the rest is compared afterwards.
PREFIX_DIGITS = 8


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null and where there is no ://."""
    host = F.regexp_extract(_rest(url), r"^[^/?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))


def prepare_rules(rules: DataFrame) -> DataFrame:
    """rule, block, digest, host_chars, path_chars of rules (host, path, action); one row for each host and path, block before allow.

    Rules with a null host, path or action are dropped; hosts are lower-cased. action: allow or block.
    """
    host = F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    one = rules.where("host is not null and path is not null and action in ('allow', 'block')").groupBy(host.alias("host"), "path").agg(F.max(F.col("action") == "block").alias("block"))
    return one.select(F.concat("host", "path").alias("rule"), "block", _digest(F.col("host"), F.col("path")).alias("digest"), F.length("host").alias("host_chars"), F.length("path").alias("path_chars"))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\0"), path), 256)


def judge(pages: DataFrame, rules: DataFrame, url_col: str = "url", keep: tuple[str, ...] = ("page_id",), default: str = "allow") -> DataFrame:
    """One row for each row of pages: the kept columns, host, path, rule, verdict.

    Each URL is expanded into its host suffixes (at dots) times its path prefixes (of the lengths that rules have), and each
    expression is hashed. Expressions meet rules on PREFIX_DIGITS digits of the digest; then whole digests are compared and
    of the rules that fit the longest wins (on a tie the longer host). Without one the verdict is default.

    Null URLs and those without :// have an empty host and path and fit no rule; repeated rows stay apart; very long hosts
    and paths are expanded no further than the longest rule; empty pages or rules work. Columns of pages that are not kept
    are not read; kept columns may have any names but host, path, rule and verdict (ValueError). Up to BROADCAST_RULES rules
    (counted) are sent to every executor, more are joined by a shuffle; the result is the same.
    """
    if taken := {"host", "path", "rule", "verdict"} & set(keep):
        raise ValueError(f"the result has columns of its own called {', '.join(sorted(taken))}")
    table = prepare_rules(rules)
    # The lengths of rules are as few as a longest rule has characters, not as many as there are rules.
    sizes = table.agg(F.count("*").alias("n"), F.sort_array(F.collect_set("path_chars")).alias("paths"), F.sort_array(F.collect_set("host_chars")).alias("hosts")).first()
    path_sizes = F.array(*map(F.lit, sizes["paths"])).cast("array<int>")
    longest_host = max(sizes["hosts"], default=0)

    kept = F.struct(F.lit(0).alias("none"), *[F.col(c).alias(f"c{k}") for k, c in enumerate(keep)])  # in one column, so that no name can clash
    rows = pages.select(F.monotonically_increasing_id().alias("row"), kept.alias("kept"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    labels = F.split(F.substring("host", -longest_host - 1, longest_host + 1), r"\.")  # no suffix longer than a rule's host is needed
    whole = F.length("host") <= longest_host
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    suffixes = F.when(F.col("host") == "", F.array().cast("array<string>")).when(whole, suffixes).otherwise(F.slice(suffixes, 2, F.size(labels)))
    prefixes = F.transform(F.filter(path_sizes, lambda n: n <= F.length("path")), lambda n: F.substr(F.col("path"), F.lit(1), n))
    digests = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: _digest(h, p))))
    wide = rows.withColumn("digest", F.explode_outer(digests)).withColumn("short", F.substring("digest", 1, PREFIX_DIGITS))

    side = table.select(F.substring("digest", 1, PREFIX_DIGITS).alias("r_short"), F.col("digest").alias("r_digest"), "rule", "block", "host_chars", "path_chars")
    if sizes["n"] <= BROADCAST_RULES:
        near = wide.join(F.broadcast(side), F.col("short") == F.col("r_short"), "left")
    else:  # common suffixes such as a top-level domain are in very many rows: their rows are dealt to salted copies of the rules
        side = side.withColumn("r_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = wide.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
        near = salted.join(side, (F.col("short") == F.col("r_short")) & (F.col("salt") == F.col("r_salt")), "left")
    fits = F.when(F.col("digest") == F.col("r_digest"), F.struct((F.col("host_chars") + F.col("path_chars")).alias("chars"), "host_chars", "rule", "block"))
    best = near.groupBy("row").agg(*[F.first(c).alias(c) for c in ("kept", "host", "path")], F.max(fits).alias("best"))
    verdict = F.when(F.col("best.block"), "block").when(F.col("best").isNotNull(), "allow").otherwise(default)
    return best.select(*[F.col(f"kept.c{k}").alias(c) for k, c in enumerate(keep)], "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"))


#: Rules of the query: host, path, action.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)


ORACLE_SQL = {
    "op1_url_filters": f"""
WITH rules(host, path, action) AS (VALUES {", ".join(f"('{h}', '{p}', '{a}')" for h, p, a in RULES)}),
cut AS (
  SELECT page_id, row_number() OVER () AS n,
    CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
parts AS (
  SELECT page_id, n,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut),
fits AS (
  SELECT p.page_id, p.n, p.host, p.path, r.host || r.path AS rule, r.action,
    row_number() OVER (PARTITION BY p.n ORDER BY length(r.host) + length(r.path) DESC NULLS LAST, length(r.host) DESC NULLS LAST) AS k
  FROM parts p LEFT JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM fits WHERE k = 1
"""
}
QUERIES = {"op1_url_filters": op1_url_filters}
