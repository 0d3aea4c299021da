import hashlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from geoloom.llm import mixing


def deal(budget, children):
    """Shares by hand: (name, weight, capacity). Fill those that can't use their share, one after the other, smallest first."""
    out, left = {n: 0 for n, w, _ in children if w == 0}, budget
    rest = [c for c in children if c[1] > 0]
    while True:
        total = sum(w for _, w, _ in rest)
        full = sorted((c for c in rest if c[2] * total <= left * c[1]), key=lambda c: c[2] / c[1])
        if not full:
            return out | {n: left * w // total for n, w, _ in rest}
        n, _, cap = full[0]
        out[n] = cap
        left -= cap
        rest = [c for c in rest if c[0] != n]
        if not rest:
            return out


def brute(docs, targets, percent, epochs, seed):
    weight = {(a, b): w for a, b, w in targets}
    rows = []
    for r in docs:
        source = r["source"] or ""
        digits = source[len(source.rstrip("0123456789")) :]
        domain = ("curated", "web")[int(digits[-9:]) % 2] if digits else "unknown"
        words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in r["text"] or "").split(" ") if w]
        rows.append((r["doc_id"], (domain, r["lang"] or "", source), len(words)))
    caps = {}
    for _, leaf, n in rows:
        for k in range(4):
            caps[leaf[:k]] = caps.get(leaf[:k], 0) + n * epochs
    budget = {(): caps.get((), 0) // epochs * percent // 100}
    for k, level in enumerate(mixing.LEVELS):
        for parent in {leaf[:k] for _, leaf, _ in rows}:
            names = sorted({leaf[k] for _, leaf, _ in rows if leaf[:k] == parent})
            shares = deal(budget[parent], [(n, weight.get((level, n), weight.get((level, "*"), 1)), caps[(*parent, n)]) for n in names])
            budget |= {(*parent, n): b for n, b in shares.items()}
    out = {}
    for leaf in {leaf for _, leaf, _ in rows}:
        tokens = caps[leaf] // epochs
        if not tokens or not budget[leaf]:
            continue
        whole, rest = divmod(budget[leaf], tokens)
        key = lambda i, e=whole: hashlib.md5(f"{seed}:{e}:{'' if i is None else i}".encode()).hexdigest()
        own = sorted(((key(i), i, n) for i, at, n in rows if at == leaf), key=lambda x: x[0])
        total = 0
        sums = {}
        for k, _, n in own:
            total += n
            sums[k] = total
        for k, i, _ in own:
            copies = whole + (rest > 0 and sums[k] <= rest)
            if copies:
                out.setdefault(i, []).append(copies)
    return out


@pytest.mark.parametrize(("percent", "epochs"), [(60, 2), (90, 1), (100, 1), (150, 3), (1, 1)])
def test_against_brute_force(sample, edge, percent, epochs):
    for docs in (sample, edge):
        got = {}
        for r in mixing.mix(docs, mixing.TARGETS, percent, epochs)[1].collect():
            got.setdefault(r["doc_id"], []).append(r["copies"])
        want = brute(docs.collect(), mixing.TARGETS, percent, epochs, mixing.SEED)
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_budgets_of_random_trees(spark):
    rng = random.Random(4)
    for _ in range(3):
        leaves = [(d, x, f"s{k}", rng.choice([1, 10, 1000, 50_000])) for d in ("a", "b") for x in ("en", "de") for k in range(rng.randint(1, 4))]
        targets = [("domain", "a", rng.randint(0, 9)), ("language", "en", 7), ("source", "s0", 3), ("source", "*", 2)]
        rows = mixing.budgets(spark.createDataFrame(leaves, "__domain string, __language string, __source string, tokens long"), targets, 70, 1).collect()
        assert all(0 <= r["budget"] <= r["tokens"] for r in rows)
        total = sum(x[3] for x in leaves) * 70 // 100
        usable = sum(x[3] for x in leaves if x[0] != "a" or targets[0][2])
        assert min(total, usable) - len(leaves) * 3 <= sum(r["budget"] for r in rows) <= total


def test_siblings_come_before_ancestors(spark):
    leaves = [("a", "en", "s1", 10), ("a", "en", "s2", 1000), ("b", "en", "s1", 1000)]
    rows = mixing.budgets(spark.createDataFrame(leaves, "__domain string, __language string, __source string, tokens long"), [], 50, 1).collect()
    got = {(r["__domain"], r["__source"]): r["budget"] for r in rows}
    assert got == {("a", "s1"): 10, ("a", "s2"): 492, ("b", "s1"): 502}


def test_all_columns_stay_and_empty_tables_work(edge, nothing):
    taken = mixing.mix(edge, mixing.TARGETS, 100, 1)[0]
    assert taken.columns == [*edge.columns, "__copies"] and taken.where("__copies > 1").isEmpty()
    assert mixing.mix(nothing, mixing.TARGETS, 50, 2)[1].isEmpty()
    blank = edge.withColumn("text", F.lit(" "))
    assert mixing.mix(blank, mixing.TARGETS, 50, 2)[1].isEmpty()


@pytest.mark.parametrize("leaves", [mixing.BROADCAST_LEAVES, 0])
def test_query_against_sql(spark, sf_dir, monkeypatch, leaves):
    monkeypatch.setattr(mixing, "BROADCAST_LEAVES", leaves)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf_dir}/documents.parquet')")
    want = db.execute(mixing.ORACLE_SQL["op2_mixing"]).fetchall()
    columns = ("doc_id", "domain", "language", "source", "n_tokens", "copies")
    assert sorted(want) == sorted(tuple(r[c] for c in columns) for r in mixing.op2_mixing(spark, sf_dir).collect())


def test_the_plan_has_no_python(sample):
    plan = mixing.mix(sample, mixing.TARGETS, 60, 2)[1]._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "MapInArrow" not in plan


def test_weights_are_checked():
    with pytest.raises(ValueError, match="whole numbers"):
        mixing._weight("source", [("source", "a", -1)])
