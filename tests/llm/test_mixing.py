import hashlib
from collections import defaultdict

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from crystalspark.llm import mixing as mx


def share(budget, caps, weights):
    """Shares of a budget among capped children in name order, by filling the fullest first."""
    open_, left, out = dict(weights), budget, {}
    while open_:
        total = sum(open_.values())
        full = [k for k in open_ if caps[k] * total <= open_[k] * left]
        if not full:
            break
        k = min(full, key=lambda k: (caps[k] / open_[k], k))
        out[k] = caps[k]
        left -= caps[k]
        del open_[k]
    total = sum(open_.values())
    low = {k: open_[k] * left // total for k in open_}
    extra = left - sum(low.values())
    for i, k in enumerate(sorted(open_)):
        out[k] = low[k] + (i < extra)
    return out


def brute(rows, fraction, epochs, seed=20, levels=("lang", "source"), weights=mx.WEIGHTS):
    leaves = defaultdict(list)
    for r in rows:
        tokens = max(1, -(-len((r[1] or "").encode()) // 4))
        leaves[tuple(r[2 + i] or "(null)" for i in range(2))].append((r[0], tokens))
    supply = {k: sum(t for _, t in v) for k, v in leaves.items()}

    def down(budget, prefix):
        if len(prefix) == len(levels):
            return {prefix: budget}
        caps = defaultdict(int)
        for k, s in supply.items():
            if k[: len(prefix)] == prefix:
                caps[k[len(prefix)]] += s * epochs
        out = {}
        for k, b in share(budget, caps, {k: weights.get(levels[len(prefix)], {}).get(k, 1) for k in caps}).items():
            out |= down(b, (*prefix, k))
        return out

    chosen = []
    for leaf, budget in down(int(sum(supply.values()) * fraction), ()).items():
        e = 1
        while budget > 0:
            limit, start = min(budget, supply[leaf]), 0
            keyed = sorted((hashlib.md5(f"{seed}:{e}:{'' if d is None else d}".encode()).hexdigest(), -1 if d is None else d, t) for d, t in leaves[leaf])
            for _, d, t in keyed:
                if start < limit:
                    chosen.append((d, *leaf, e, start, t, min(t, limit - start)))
                start += t
            budget -= limit
            e += 1
    return sorted(chosen)


def test_against_brute_force(docs, clashing, no_docs, rows):
    for fraction, epochs in ((0.5, 2), (1.5, 3), (9.0, 2), (0.01, 1)):
        found = mx.mix(docs, fraction, epochs, levels=("lang", "source")).collect()
        assert sorted((-1 if r.doc_id is None else r.doc_id, *r[1:]) for r in found) == brute(rows, fraction, epochs)
    assert mx.mix(clashing, levels=("lang", "source")).count() == mx.mix(docs, levels=("lang", "source")).count()
    assert mx.mix(no_docs, levels=("lang", "source")).collect() == []


def test_sql_gives_the_same(spark, docs, rows):
    frame = pd.DataFrame(rows, columns=docs.columns).astype({"doc_id": "Int64"})
    con = duckdb.connect()
    con.register("documents", frame)
    want = con.execute(mx.oracle()).fetchall()
    found = mx.mix(mx.with_domain(docs)).select("doc_id", "domain", "lang", "source", "epoch", "start", "tokens", "taken").collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, want)) == sorted(map(key, found))


def test_shortage_stays_among_siblings(spark):
    rows = [(i, "x" * 400, d, s) for i, (d, s) in enumerate([("a", "p")] * 1 + [("a", "q")] * 50 + [("b", "r")] * 50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, domain string, source string")
    found = mx.mix(df, 0.4, 1, levels=("domain", "source"), weights={}).groupBy("domain").agg(F.sum("taken").alias("n")).collect()
    n = {r.domain: r.n for r in found}
    assert abs(n["a"] - n["b"]) <= 1
