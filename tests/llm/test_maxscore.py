import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crystalspark.llm import maxscore
from crystalspark.llm.common import delete

ITEMS = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType())])
TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))))


def brute(rows, items, k=10):
    """(item_id, rank, doc_id, score) by scoring every document for every item."""
    docs = [(r[0], Counter(terms(r[1]))) for r in rows]
    docs = [(i, c, sum(c.values())) for i, c in docs]
    n, total = sum(1 for d in docs if d[2]), sum(d[2] for d in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in items:
        query, scored = Counter(terms(text)), []
        for i, c, length in docs:
            m = 25 + (75 * length * n) // total if total else 0
            score = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t, q in query.items() if t in c)
            if score > 0:
                scored.append((-score, i is None, i))
        out += [(item, rank + 1, i, -s) for rank, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def items(rows):
    rng = random.Random(5)
    out = []
    for k in range(25):
        words = (rng.choice(rows)[1] or "").split()[: rng.randint(1, 30)]
        out.append((k, " ".join(words * rng.randint(1, 2)).upper() if k % 4 == 0 else " ".join(words)))
    return out + [(90, None), (91, ""), (92, "zzzzunknown"), (None, "one two"), (3, "one"), (3, "one")]


@pytest.mark.parametrize("shard_bytes,window,block_bytes", [(1 << 20, 2048, 4 << 20), (3000, 4, 900)])
def test_against_scoring_everything(spark, docs, rows, items, shard_bytes, window, block_bytes):
    index = maxscore.build(docs, shard_bytes=shard_bytes)
    found = maxscore.search(index, spark.createDataFrame(items, ITEMS), window=window, block_bytes=block_bytes)
    assert sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in found.collect()), key=str) == brute(rows, items)
    if shard_bytes == 3000:
        assert index.where("kind = 'docs'").count() > 10
    for path in {f.split("/kind=")[0] for f in index.inputFiles()}:
        delete(spark, path)


def test_non_essential_postings_are_probed_for_few_documents():
    rng = np.random.default_rng(1)
    n = 20_000
    rare, common = np.sort(rng.choice(n, 60, replace=False)), np.arange(n)
    lists = [(rare, rng.integers(5000, 9000, 60)), (common, rng.integers(1, 40, n))]
    probed: list[int] = []
    best = maxscore.max_score(lists, n, 10, 512, probed)
    scores = np.zeros(n, np.int64)
    for places, gains in lists:
        scores[places] += gains
    order = np.lexsort((np.arange(n), -scores))[:10]
    assert best.places.tolist() == order.tolist() and best.scores.tolist() == scores[order].tolist()
    assert sum(probed) < 60  # of 20,000 postings of the common term


def test_random_lists_with_ties():
    rng = np.random.default_rng(2)
    for _ in range(200):
        n = int(rng.integers(1, 300))
        lists = []
        for _ in range(int(rng.integers(1, 7))):
            places = np.sort(rng.choice(n, int(rng.integers(1, n + 1)), replace=False))
            lists.append((places, rng.integers(1, 5, len(places)) * int(rng.integers(1, 4))))
        scores = np.zeros(n, np.int64)
        for places, gains in lists:
            scores[places] += gains
        order = [p for p in np.lexsort((np.arange(n), -scores)).tolist() if scores[p] > 0][:10]
        assert maxscore.max_score(lists, n, 10, 16).places.tolist() == order


def test_empty_tables_and_clashing_names(spark, docs, no_docs, clashing, rows, items):
    queries = spark.createDataFrame(items[:5], ITEMS)
    assert maxscore.rank_all(no_docs, queries).count() == 0
    assert maxscore.rank_all(docs, spark.createDataFrame([], ITEMS)).count() == 0
    odd = queries.select("*", *[F.lit(1).alias(c) for c in ("rank", "score", "body", "block", "item", "shard")])
    more = clashing.withColumns({c: F.lit(1) for c in ("id", "body", "term", "kind", "ids")})
    found = maxscore.rank_all(more, odd)
    assert sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in found.collect()), key=str) == brute(rows, items[:5])
