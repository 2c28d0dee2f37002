import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crystalspark.llm import delta_lloyd

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())])


def brute(rows, parts=8, entries=16, rounds=6):
    """Plain Lloyd over all rows, without deltas."""
    width = 16
    kept = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    size, first = width // parts, {}
    for i, q, _ in kept:
        if i is not None and (i not in first or q < first[i]):
            first[i] = q
    seeds = [first[i] for i in sorted(first)[:entries]]
    books = [[q[p * size : (p + 1) * size] for q in seeds] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            held = {}
            for _, q, _ in kept:
                x = q[p * size : (p + 1) * size]
                held.setdefault(near(x, books[p])[1], []).append(x)
            for e, xs in held.items():
                books[p][e] = [sum(c) // len(xs) for c in zip(*xs)]
    out = []
    for i, q, label in kept:
        found = [near(q[p * size : (p + 1) * size], books[p]) for p in range(parts)]
        out.append((i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), label))
    totals = {}
    for _, _, d, label in out:
        totals[label] = totals.get(label, 0) + d
    return sorted(((i, c, d, totals[label]) for i, c, d, label in out), key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = [(i, [rng.gauss(0, 1) * rng.choice([0.1, 1]) for _ in range(16)], rng.choice([None, 1, 1, 2])) for i in range(300)]
    out += [(5, out[9][1], 1), (7, out[7][1], 1), (7, out[7][1], 1)]  # a repeated id with another vector, repeated rows
    out += [(400 + i, [0.25] * 16, 3) for i in range(150)]  # a hot vector: ties
    out += [(900, None, 1), (901, [float("nan")] + [0.0] * 15, 1), (902, [None] + [0.0] * 15, 1), (903, [float("inf")] + [0.0] * 15, None), (None, [0.5] * 16, 2)]
    return out


@pytest.mark.parametrize("rounds", [0, 1, 6])
def test_against_plain_rounds(spark, rows, rounds):
    vectors = spark.createDataFrame([(i, v and [None if x is None else float(x) for x in v], label) for i, v, label in rows], SCHEMA).repartition(5)
    exact = [(r.vec_id, r.embedding and list(r.embedding), r.label) for r in vectors.collect()]
    found = delta_lloyd.compress(vectors, rounds=rounds)
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in found.collect()), key=str) == brute(exact, rounds=rounds)


def test_deltas_add_up_and_only_moved_parts_are_summed(spark, rows):
    good = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    blocks = delta_lloyd.materialise(delta_lloyd.pack(spark.createDataFrame(good, SCHEMA).coalesce(1), 16), "t")
    books, last = delta_lloyd.fit(blocks, rounds=3)
    again = last.mapInArrow(delta_lloyd._steps(books, 16), last.schema)
    moved = again.select(F.inline("delta")).agg(F.sum("n")).first()[0] or 0
    assert moved == 0  # every minus has its plus
    still = again.mapInArrow(delta_lloyd._steps(books, 16), last.schema)
    assert still.select(F.inline("delta")).count() == 0


def test_other_lengths_huge_components_and_empty(spark):
    rows = [(i, [float(i), 1.0] * 8, 1) for i in range(20)] + [(30, [1.0], 1), (31, [], 1), (32, [1e30] + [0.0] * 15, 1)]
    found = {r.vec_id: r for r in delta_lloyd.compress(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(found) == 23 and all(found[i].code is None and found[i].error is None for i in (30, 31, 32)) and len(found[0].code) == 16
    assert delta_lloyd.compress(spark.createDataFrame([], SCHEMA)).count() == 0
    nothing = delta_lloyd.compress(spark.createDataFrame([(1, None, 1)], SCHEMA))
    assert nothing.count() == 0
    nameless = delta_lloyd.compress(spark.createDataFrame([(None, [1.0] * 16, 1)], SCHEMA)).collect()
    assert nameless[0].code is None


def test_few_vectors_clashing_names_and_wide_components(spark):
    rows = [(i, [i * 9000.0, 0.0] * 8, 1) for i in range(3)]
    frame = spark.createDataFrame(rows, SCHEMA)
    clash = frame.select("*", *[F.lit("x").alias(c) for c in ("width", "ids", "codes", "delta", "code", "error", "_salt", "data")])
    found = sorted((r.vec_id, r.code, r.error, r.label_error) for r in delta_lloyd.compress(clash).collect())
    assert found == [(0, "00" * 8, 0, 0), (1, "01" * 8, 0, 0), (2, "02" * 8, 0, 0)]


def test_many_labels_join_salted(spark, monkeypatch, rows):
    monkeypatch.setattr(delta_lloyd, "BROADCAST_ROWS", 0)
    good = [(i, v, label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    vectors = spark.createDataFrame(good, SCHEMA)
    exact = [(r.vec_id, list(r.embedding), r.label) for r in vectors.collect()]
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in delta_lloyd.compress(vectors).collect()), key=str) == brute(exact)
