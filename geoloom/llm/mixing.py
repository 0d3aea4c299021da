"""Mixing sources to target weights: budgets handed down a tree, shortages taken up by siblings first, seeded epochs.

All of it is DataFrame functions. The tree has the levels domain, language, source. Capacities (tokens times the epochs
allowed) are summed upwards; budgets go downwards. At each node the budget is dealt to the children by weight; a child whose
subtree can't use its share takes all it can, and the rest is dealt to its siblings by weight. Only what no child can use
stays unspent below the parent, whose own siblings have taken it up by then, as its capacity was known to them. Children are
taken in order of capacity per weight: those before the first that can use its share are filled, the others share the rest.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geoloom.llm.common import WORD, documents, materialize

LEVELS = ("domain", "language", "source")
WHOLE = "decimal(38,0)"

#: Hex digits of the order key that bin a leaf's documents, and how often: of 256 bins the one in which the budget ends is
#: binned again, and of that one's bins a single one is put in order.
BIN_DIGITS, BIN_LEVELS = 2, 2

#: Weights of the query: (level, name, weight). A name that isn't listed has the weight of '*', or 1.
TARGETS = [("domain", "curated", 60), ("domain", "web", 40), ("language", "en", 40), ("language", "de", 25), ("language", "fr", 20), ("language", "es", 15), ("source", "src0", 2)]
SEED = 20


def place(lang: Column, source: Column) -> list[Column]:
    """domain, language and source of documents. Domain: curated or web, by the parity of the number that ends the source's
    name, else unknown. Null languages and sources are leaves of the empty name."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), r"([0-9]{1,9})$", 1).try_cast("bigint")
    domain = F.when(number % 2 == 0, "curated").when(number % 2 == 1, "web").otherwise("unknown")
    return [domain.alias("__domain"), F.coalesce(lang, F.lit("")).alias("__language"), F.coalesce(source, F.lit("")).alias("__source")]


def order_key(seed: int, epoch: Column, id_: Column) -> Column:
    """The place of a document in an epoch; a null id counts as the empty text."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(id_.cast("string"), F.lit(""))).cast("binary"))


def n_words(text: Column) -> Column:
    """Tokens of the budget: words between ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _weight(level: str, targets: list[tuple[str, str, int]]) -> Column:
    named = {name: int(w) for at, name, w in targets if at == level}
    if any(w < 0 or w > 10_000 for w in named.values()):
        raise ValueError("weights are whole numbers from 0 to 10,000")
    rest = F.lit(named.pop("*", 1))
    return reduce(lambda c, x: F.when(F.col(f"__{level}") == x[0], x[1]).otherwise(c), named.items(), rest).cast(WHOLE)


def budgets(leaves: DataFrame, targets: list[tuple[str, str, int]], percent: int, epochs: int) -> DataFrame:
    """leaves (__domain, __language, __source, tokens) with budget: whole tokens of a total of percent of all tokens."""
    out = leaves.withColumn("capacity", (F.col("tokens") * epochs).cast(WHOLE))
    above, on = None, []
    for level in LEVELS:
        here = [*on, f"__{level}"]
        node = out.groupBy(*here).agg(F.sum("capacity").cast(WHOLE).alias("capacity")).withColumn("w", _weight(level, targets))
        parent = Window.partitionBy(*on) if on else Window.partitionBy(F.lit(0))  # the domains, which are few
        node = node.join(above, on) if on else node.withColumn("budget", F.expr(f"cast(sum(capacity) over (partition by 0) div {epochs} * {percent} div 100 as decimal(38,0))"))
        order = parent.orderBy(F.when(F.col("w") > 0, F.col("capacity").cast("double") / F.col("w").cast("double")).asc_nulls_last(), f"__{level}")
        earlier = F.coalesce(F.sum("capacity").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        node = node.withColumns({"left": (F.col("budget") - earlier).cast(WHOLE), "ws": F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)).cast(WHOLE)})
        node = node.withColumn("open", (F.col("w") > 0) & (F.col("capacity") * F.col("ws") > F.col("left") * F.col("w")))
        node = node.withColumn("rest", F.max(F.when(F.col("open"), F.struct("ws", "left"))).over(parent))
        share = F.expr("cast(rest.left * w div rest.ws as decimal(38,0))")
        above = node.select(*here, F.when(F.col("open"), share).when(F.col("w") > 0, F.col("capacity")).otherwise(0).cast(WHOLE).alias("budget"))
        on = here
    return leaves.join(above, on).withColumn("budget", F.col("budget").cast("long"))


#: Leaves whose cut-offs are sent to every executor; with more (counted) the rows are shuffled by leaf, and adaptive execution
#: splits what a hot leaf gathers. The result is the same.
BROADCAST_LEAVES = 200_000


def _leaf_join(rows: DataFrame, table: DataFrame) -> DataFrame:
    """rows with their leaf's row of a written table, which has one for each leaf at most."""
    few = table.limit(BROADCAST_LEAVES + 1).count() <= BROADCAST_LEAVES
    return rows.join(F.broadcast(table) if few else table, [f"__{c}" for c in LEVELS])


def cutoffs(counted: DataFrame, targets: list[tuple[str, str, int]], percent: int, epochs: int, seed: int) -> DataFrame:
    """For each leaf: __epochs (times that all its documents are taken) and __cutoff (the last order key that the next epoch
    takes, or a text before all keys). counted: __id, __domain, __language, __source, tokens."""
    names = [f"__{c}" for c in LEVELS]
    leaves = materialize(counted.groupBy(*names).agg(F.sum("tokens").alias("tokens")), "leaves")
    plan = budgets(leaves, targets, percent, epochs)
    plan = materialize(plan.where("budget > 0 and tokens > 0").selectExpr(*names, "budget div tokens as __epochs", "budget % tokens as __rest"), "budgets")
    key = order_key(seed, F.col("__epochs"), F.col("__id"))
    cut = plan.where("__rest > 0").select(*names, "__epochs", "__rest", F.lit("").alias("__bin"), F.lit(0).cast("long").alias("__before"))
    for depth in range(1, BIN_LEVELS + 1):  # narrow down the bin in which each leaf's budget ends
        bins = _inside(counted, cut, key).groupBy(*names, F.substring("__key", 1, depth * BIN_DIGITS).alias("__bin"))
        bins = bins.agg(F.sum("tokens").alias("n"), *[F.first(c).alias(c) for c in ("__epochs", "__rest", "__before")])
        through = F.col("__before") + F.sum("n").over(Window.partitionBy(*names).orderBy("__bin"))
        ends = bins.withColumn("__through", through).where("__through > __rest and __through - n <= __rest and n > 0")
        cut = materialize(ends.select(*names, "__epochs", "__rest", "__bin", (F.col("__through") - F.col("n")).alias("__before")), "bins")
    last = _inside(counted, cut, key).groupBy(*names, "__key").agg(F.sum("tokens").alias("n"), *[F.first(c).alias(c) for c in ("__rest", "__before")])
    upto = F.col("__before") + F.sum("n").over(Window.partitionBy(*names).orderBy("__key"))
    last = last.withColumn("__upto", upto).where("__upto <= __rest").groupBy(*names).agg(F.max("__key").alias("__key"))
    ends = cut.select(*names, "__bin").join(last, names, "left").select(*names, F.coalesce("__key", "__bin").alias("__cut"))
    return materialize(plan.join(ends, names, "left").select(*names, "__epochs", F.coalesce("__cut", F.lit("")).alias("__cutoff")), "cutoffs")


def _inside(counted: DataFrame, cut: DataFrame, key: Column) -> DataFrame:
    """The rows in each leaf's bin, with their keys. All of a leaf's keys are longer than its bin, and no key equals one."""
    return _leaf_join(counted, cut).withColumn("__key", key).where(F.col("__key").startswith(F.col("__bin")))


def mix(
    docs: DataFrame, targets: list[tuple[str, str, int]], percent: int, epochs: int, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source"
) -> tuple[DataFrame, DataFrame]:
    """(taken, counted). taken: docs with __copies, the times that a row is taken, without rows that aren't.
    counted: id, domain, language, source, n_tokens and copies of the rows that are taken, without their texts.

    The budget is percent of all words; a document can be taken epochs times at most. In each epoch a leaf's documents are
    in an order fixed by the seed, the epoch and the ids, and the last epoch takes the longest prefix that keeps to the
    leaf's budget; rows of one id are taken together. Rounding leaves less than a word a leaf unspent, besides the words of
    the document at which a prefix ends. Null and empty texts have no words: they are taken when their place is inside the
    prefix. Null languages, sources and ids are names of their own (the empty text). Leaves of weight 0 give nothing. Empty
    tables give empty results. Columns of docs may have any names that don't begin with two underscores.
    """
    placed = docs.select("*", F.col(id_col).alias("__id"), *place(F.col(lang_col), F.col(source_col)))
    counted = materialize(placed.select("__id", *[f"__{c}" for c in LEVELS], n_words(F.col(text_col)).alias("tokens")), "counted")
    table = cutoffs(counted, targets, percent, epochs, seed)

    def take(rows: DataFrame) -> DataFrame:
        again = (order_key(seed, F.col("__epochs"), F.col("__id")) <= F.col("__cutoff")).cast("long")
        return _leaf_join(rows, table).withColumn("__copies", F.col("__epochs") + again).where("__copies > 0")

    return (
        take(placed).select(*docs.columns, "__copies"),
        take(counted).select(F.col("__id").alias(id_col), *[F.col(f"__{c}").alias(c) for c in LEVELS], F.col("tokens").alias("n_tokens"), F.col("__copies").alias("copies")),
    )


PERCENT, EPOCHS = 60, 2


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir), TARGETS, PERCENT, EPOCHS)[1]


def _level_sql(k: int) -> str:
    level, here, on = LEVELS[k], ", ".join(LEVELS[: k + 1]), ", ".join(LEVELS[:k])
    weight = f"CASE {level} " + " ".join(f"WHEN '{n}' THEN {w}" for at, n, w in TARGETS if at == level) + " ELSE 1 END"
    above = f"JOIN dealt{k - 1} USING ({on})" if k else "CROSS JOIN total"
    parent = f"PARTITION BY {on}" if k else ""
    order = f"{parent} ORDER BY capacity::DOUBLE / w::DOUBLE, {level}"
    return f"""
node{k} AS (SELECT {here}, sum(capacity)::HUGEINT AS capacity, ({weight})::HUGEINT AS w FROM leaves GROUP BY ALL),
water{k} AS (
  SELECT *, budget - coalesce(sum(capacity) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS free,
    sum(w) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws
  FROM node{k} {above}),
open{k} AS (SELECT *, capacity * ws > free * w AS is_open FROM water{k}),
rest{k} AS (
  SELECT *, arg_max(free, ws) FILTER (WHERE is_open) OVER ({parent}) AS rest_free, max(ws) FILTER (WHERE is_open) OVER ({parent}) AS rest_ws
  FROM open{k}),
dealt{k} AS (SELECT {here}, (CASE WHEN is_open THEN rest_free * w // rest_ws ELSE capacity END)::HUGEINT AS budget FROM rest{k})"""


ORACLE_SQL = {
    "op2_mixing": f"""
WITH counted AS (
  SELECT doc_id,
    coalesce(CASE TRY_CAST(regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) AS BIGINT) % 2 WHEN 0 THEN 'curated' WHEN 1 THEN 'web' END, 'unknown') AS domain,
    coalesce(lang, '') AS language, coalesce(source, '') AS source,
    coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS n_tokens
  FROM documents),
leaves AS (SELECT domain, language, source, sum(n_tokens)::HUGEINT AS tokens, sum(n_tokens)::HUGEINT * {EPOCHS} AS capacity FROM counted GROUP BY ALL),
total AS (SELECT (sum(tokens) * {PERCENT}) // 100 AS budget FROM leaves),
{",".join(_level_sql(k) for k in range(3))},
plan AS (
  SELECT domain, language, source, budget // tokens AS full_epochs, budget % tokens AS rest
  FROM leaves JOIN dealt2 USING (domain, language, source) WHERE budget > 0 AND tokens > 0),
keyed AS (
  SELECT *, md5('{SEED}:' || full_epochs::VARCHAR || ':' || coalesce(doc_id::VARCHAR, '')) AS k
  FROM counted JOIN plan USING (domain, language, source)),
prefixes AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, language, source ORDER BY k) AS upto FROM keyed)
SELECT doc_id, domain, language, source, n_tokens, (full_epochs + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END)::BIGINT AS copies
FROM prefixes WHERE full_epochs > 0 OR (rest > 0 AND upto <= rest)
"""
}
QUERIES = {"op2_mixing": op2_mixing}
