import random

import numpy as np
import pytest

from crystalspark.llm import toxicity as tx
from crystalspark.llm.common import crc_mod

BAD = ["blorgface", "snarkweed", "dumfel"]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice(["ba", "lo", "ri", "ten", "mor", "sha", "ing", "ed"]) for _ in range(rng.randint(1, 4))) for _ in range(200)]
    rows, labels = [], []
    for i in range(600):
        text = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        bad = i % 5 == 0
        if bad:
            text[rng.randrange(len(text))] = rng.choice(BAD)
        rows.append((i, " ".join(text), "en"))
        if i < 400:
            labels.append((i, int(bad)))
    for k, t in enumerate(["hello you bl0rgf4ce ten", "mor b l o r g f a c e lo", "s.n.a.r.k.w.e.e.d", "duuuuuumfeeeel sha", "$n4rkw33d!!", "ten dum​fel"]):
        rows.append((1000 + k, t, "en"))
    rows += [(2000, None, "en"), (2001, "", None), (None, "lo ri", "de"), (2002, "x" * 300_000 + " " + "ba " * 50_000, "en"), rows[0], rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(4)
    labs = spark.createDataFrame(labels + [(None, 1), (5, None)], "doc_id long, toxic int")
    return docs, labs, rows


def test_scores(spark, corpus):
    docs, labels, rows = corpus
    model = tx.fit(docs, labels, crc_mod("doc_id", 4) != 2)
    found = tx.score(docs, model).collect()
    assert len(found) == len(rows)
    by = {r.doc_id: r.score for r in found}
    assert all((by[i] >= 0.3) == (i % 5 == 0) for i in range(600))
    assert all(by[1000 + k] >= 0.3 for k in range(6)), {k: by[1000 + k] for k in range(6)}
    assert by[2000] == by[2001] < 0.3 and by[2002] < 0.3 and all(0 <= s <= 1 for s in by.values())
    texts = {r.doc_id: r.restored for r in tx.score(docs.where("doc_id >= 1000 AND doc_id < 1006"), model, keep_restored="restored").collect()}
    assert "blorgface" in texts[1000] and "snarkweed" in texts[1002] and "dumfel" in texts[1003] and "dumfel" in texts[1005]


def test_odd_tables(spark, corpus):
    docs, labels, _ = corpus
    none = tx.fit(docs.limit(0), labels, crc_mod("doc_id", 4) != 2)
    assert tx.score(docs.limit(0), none).collect() == []
    one_class = tx.fit(docs, labels.where("toxic = 0"), crc_mod("doc_id", 4) != 2)
    assert {round(r.score, 6) for r in tx.score(docs, one_class).collect()} == {round(1 / (1 + np.exp(-one_class.bias)), 6)}


def test_decoding_is_the_cheapest_path():
    rng = np.random.default_rng(2)
    model = tx.smooth(rng.integers(0, 50, (28, 28, 28)).astype(float)).tolist()

    def slow(places, a=0, b=0):
        if not places:
            return model[a][b][0], ""
        out = []
        for reading, price in places[0]:
            x, y, total = a, b, price
            for c in reading:
                total += model[x][y][tx.symbol(c)]
                x, y = y, tx.symbol(c)
            rest, text = slow(places[1:], x, y)
            out.append((total + rest, reading + text))
        return min(out)

    for token in ("1d10t", "a.b-c", "heeello", "$t0p!", "l33t", "x_y"):
        assert tx.decode(token, model) == slow(tx.lattice(token))[1].strip()


def test_held_out_rows_are_never_learnt(spark, corpus):
    docs, labels, _ = corpus
    from pyspark.sql import functions as F

    flipped = labels.withColumn("toxic", F.when(crc_mod("doc_id", 4) == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (tx.fit(docs, x, crc_mod("doc_id", 4) != 2) for x in (labels, flipped))
    assert a.inputs == b.inputs and np.allclose(a.weights, b.weights)
