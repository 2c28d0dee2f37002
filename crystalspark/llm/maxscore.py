"""Ranked lexical search with MaxScore, shard by shard.

``build`` turns documents into a sharded inverted index without a shuffle: a
task cuts its documents into shards of about ``SHARD_BYTES`` of text and writes
one row per (shard, term) with the postings, and one row per shard with its
documents' ids and lengths. Collection statistics are sums over those rows.

``search`` takes queries in blocks of bounded size. The index rows of a block's
terms are shuffled by shard; each shard, one bounded group, runs MaxScore for
every query of the block: the query's lists are ordered by their upper bound
(the highest contribution in the shard), the longest prefix whose bounds sum to
no more than the k-th best score so far is non-essential, candidates come from
the other lists, window by window in ascending document order, and postings of
the non-essential lists are probed only for documents that can still qualify.
The best k of each shard meet in one ranking, after the k best of every task.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from crystalspark.llm.common import delete, materialise, raw
from crystalspark.llm.decontaminate import words_of

#: Bytes of text in a shard (one longer document is a shard of its own), documents in a window of candidates.
SHARD_BYTES, WINDOW = 8 << 20, 2048
#: Bytes of queries that travel to the tasks at once.
BLOCK_BYTES = 4 << 20


def build(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The written index: kind ('docs' or 'terms'), shard, term, n_docs, n_terms, places and counts (32-bit), ids.

    A 'terms' row has the places of the documents that hold the term (their
    order within the shard, by ascending id) and how often; n_docs is their
    number. The 'docs' row has all ids and term counts of the shard, n_docs the
    documents with a term and n_terms their terms. Null and empty texts have no
    terms; repeated rows are documents of their own; null ids come last. A very
    long text is read whole. Other columns are not read.
    """
    kind = dict(docs.dtypes)[doc_id]
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), raw(F.col(f"`{text}`")).alias("body"))

    def run(batches):
        from pyspark import TaskContext

        shard, held, ids, counts = TaskContext.get().partitionId() << 32, 0, [], []
        for batch in batches:
            start = 0
            for k, body in enumerate(batch.column("body")):
                found = Counter(words_of(body.as_py()))
                counts.append(found)
                held += len(body.as_py())
                if held >= shard_bytes:
                    ids.append(batch.column("id").slice(start, k + 1 - start))
                    yield from _shard_rows(shard, pa.concat_arrays(ids), counts)
                    shard, held, ids, counts, start = shard + 1, 0, [], [], k + 1
            ids.append(batch.column("id").slice(start))
        if counts:
            yield from _shard_rows(shard, pa.concat_arrays(ids), counts)

    schema = f"kind string, shard long, term binary, n_docs long, n_terms long, places binary, counts binary, ids array<{kind}>"
    return materialise(rows.mapInArrow(run, schema), "lexical-index", ["kind"])


def _shard_rows(shard: int, ids: pa.Array, found: list[Counter]):
    """Record batches of one shard's index rows."""
    order = pc.sort_indices(ids, null_placement="at_end").to_numpy()
    vocabulary: dict[bytes, int] = {}
    terms, counts, sizes = [], [], []
    for k in order.tolist():
        terms.extend(found[k])
        counts.extend(found[k].values())
        sizes.append(len(found[k]))
    numbers = np.fromiter((vocabulary.setdefault(t, len(vocabulary)) for t in terms), dtype=np.int64, count=len(terms))
    counts, places = np.array(counts, dtype=np.uint32), np.repeat(np.arange(len(order), dtype=np.uint32), sizes)
    lengths = np.add.reduceat(np.append(counts, 0).astype(np.int64), np.cumsum([0, *sizes[:-1]])) * (np.array(sizes) > 0)
    by_term = np.argsort(numbers, kind="stable")
    n_docs = np.bincount(numbers, minlength=len(vocabulary))
    names = ["kind", "shard", "term", "n_docs", "n_terms", "places", "counts", "ids"]
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(["docs"]), pa.array([shard]), pa.array([None], pa.binary()), pa.array([int((lengths > 0).sum())]), pa.array([int(lengths.sum())]),
            pa.array([None], pa.binary()), pa.array([lengths.astype(np.uint32).tobytes()], pa.binary()), pa.ListArray.from_arrays([0, len(ids)], ids.take(pa.array(order))),
        ],
        names=names,
    )
    ends = np.concatenate(([0], np.cumsum(n_docs))) * 4
    names_of = list(vocabulary)
    n_terms = np.add.reduceat(counts[by_term].astype(np.int64), ends[:-1] // 4) if len(names_of) else np.empty(0, np.int64)
    for a in range(0, len(names_of), 10_000):
        b = min(a + 10_000, len(names_of))
        cut, part = slice(ends[a] // 4, ends[b] // 4), pa.py_buffer((ends[a : b + 1] - ends[a]).astype(np.int32))
        blobs = [pa.Array.from_buffers(pa.binary(), b - a, [None, part, pa.py_buffer(v[by_term][cut].tobytes())]) for v in (places, counts)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(["terms"] * (b - a)), pa.array([shard] * (b - a)), pa.array(names_of[a:b], pa.binary()), pa.array(n_docs[a:b]), pa.array(n_terms[a:b]), *blobs,
                pa.nulls(b - a, pa.list_(ids.type)),
            ],
            names=names,
        )


def weight(n: int, df: int) -> int:
    """Weight of a term that df of n documents hold."""
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def damping(lengths: np.ndarray, n: int, total: int) -> np.ndarray:
    """Each document's m, from its length, the number of documents and all their terms."""
    return np.array([25 + 75 * x * n // total for x in lengths.tolist()], dtype=np.int64)


class Best:
    """The k best (score, place) so far: highest score first, then lowest place. Places come in ascending windows."""

    def __init__(self, k: int):
        self.k, self.scores, self.places = k, np.empty(0, np.int64), np.empty(0, np.int64)

    @property
    def bar(self) -> int:
        """A document has to score more than this."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 0

    def add(self, scores: np.ndarray, places: np.ndarray) -> None:
        scores, places = np.concatenate((self.scores, scores)), np.concatenate((self.places, places))
        order = np.lexsort((places, -scores))[: self.k]
        self.scores, self.places = scores[order], places[order]


def max_score(lists: list[tuple[np.ndarray, np.ndarray]], n: int, k: int, window: int = WINDOW, probed: list | None = None) -> Best:
    """The k best of n documents for the lists (places ascending, contributions) of a query; ``probed`` collects how many postings were looked up."""
    lists = sorted(((int(c.max()), p, c) for p, c in lists), key=lambda x: x[0])
    bounds = np.cumsum([0, *[x[0] for x in lists]])
    best = Best(k)
    for first in range(0, n, window):
        split = int(np.searchsorted(bounds[1:], best.bar, side="right"))  # lists below add up to no more than the bar
        if split == len(lists):
            break
        scores = np.zeros(min(window, n - first), dtype=np.int64)
        for _, places, gains in lists[split:]:
            a, b = np.searchsorted(places, (first, first + window))
            scores[places[a:b] - first] += gains[a:b]
        left = np.flatnonzero(scores)
        scores = scores[left]
        for at in range(split - 1, -1, -1):
            can = scores + bounds[at + 1] > best.bar
            left, scores = left[can], scores[can]
            if not len(left):
                break
            _, places, gains = lists[at]
            found = np.minimum(np.searchsorted(places, left + first), len(places) - 1)
            scores = scores + np.where(places[found] == left + first, gains[found], 0)
            if probed is not None:
                probed.append(len(left))
        can = scores > best.bar
        if can.any():
            best.add(scores[can], left[can] + first)
    return best


def search(index: DataFrame, queries: DataFrame, k: int = 10, item_id: str = "item_id", text: str = "text", block_bytes: int = BLOCK_BYTES, window: int = WINDOW) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each row of ``queries``, scores above 0 only.

    Equal scores rank by ascending doc_id, null ids last. A row of ``queries``
    is an item of its own: rows that repeat an id are each ranked, from 1.
    Null or empty query texts, and texts without a known term, return nothing,
    as do an empty index and an empty table of queries. Other columns of
    ``queries`` are not read.
    """
    spark = index.sparkSession
    documents, postings = index.where("kind = 'docs'"), index.where("kind = 'terms'")
    n, total = documents.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    kinds = {"item_id": dict(queries.dtypes)[item_id], "doc_id": dict(index.dtypes)["ids"][len("array<") : -1]}
    items = queries.select(F.col(f"`{item_id}`").alias("item_id"), raw(F.col(f"`{text}`")).alias("body"))
    size = items.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    schema = f"block int, item int, item_id {kinds['item_id']}, doc_id {kinds['doc_id']}, score long"
    found = spark.createDataFrame([], schema)
    for block in range(blocks if n else 0):
        part = (items.where(F.pmod(F.xxhash64("item_id", "body"), F.lit(blocks)) == block) if blocks > 1 else items).toArrow()
        wanted = [Counter(words_of(x)) for x in part.column("body").to_pylist()]
        terms = sorted({t for w in wanted for t in w})
        named = F.broadcast(spark.createDataFrame([(t,) for t in terms], "term binary"))  # of at most block_bytes of text
        rows = postings.join(named, "term", "left_semi")
        weights = {bytes(r.term): weight(n, r.df) for r in rows.groupBy("term").agg(F.sum("n_docs").alias("df")).collect()}
        shared = spark.sparkContext.broadcast((part.column("item_id").combine_chunks(), wanted, weights))
        columns = ["shard", "term", "places", "counts", "ids"]
        grouped = rows.select(*columns).unionByName(documents.select(*columns)).groupBy("shard")
        found = found.union(grouped.applyInArrow(_search_shard(shared, block, n, total, k, window), schema))
    order = W.partitionBy("block", "item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


def _search_shard(shared, block: int, n: int, total: int, k: int, window: int):
    names = ["block", "item", "item_id", "doc_id", "score"]

    def run(shard: pa.Table) -> pa.Table:
        items, wanted, weights = shared.value
        terms, at = shard.column("term").to_pylist(), 0
        at = terms.index(None)
        ids = shard.column("ids")[at].values
        m = damping(np.frombuffer(shard.column("counts")[at].as_py(), dtype=np.uint32), n, total)
        lists = {}
        for term, places, counts in zip(terms, shard.column("places"), shard.column("counts")):
            if term is not None and weights[term]:
                places = np.frombuffer(places.as_py(), dtype=np.uint32).astype(np.int64)
                tf = np.frombuffer(counts.as_py(), dtype=np.uint32).astype(np.int64)
                lists[term] = places, weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[places]))
        out = []
        for item, query in enumerate(wanted):
            best = max_score([(lists[t][0], lists[t][1] * times) for t, times in query.items() if t in lists], len(ids), k, window)
            if len(best.scores):
                out.append((np.full(len(best.scores), item, np.int32), best.places, best.scores))
        item, places, scores = (np.concatenate([x[c] for x in out]) if out else np.empty(0, np.int64) for c in range(3))
        item = pa.array(item, pa.int32())
        columns = [pa.array(np.full(len(places), block), pa.int32()), item, items.take(item), ids.take(pa.array(places, pa.int64())), pa.array(scores, pa.int64())]
        return pa.Table.from_arrays(columns, names=names)

    return run


def rank_all(docs: DataFrame, queries: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Index ``docs``, search, and delete the index: see ``build`` and ``search``."""
    index = build(docs, text, doc_id)
    found = materialise(search(index, queries, k, **options), "lexical-found")
    for path in {f.split("/kind=")[0] for f in index.inputFiles()}:
        delete(docs.sparkSession, path)
    return found


ORACLE = r"""
WITH letters AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS upper, 'abcdefghijklmnopqrstuvwxyz' AS lower),
dt AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, upper, lower), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents, letters
),
qt AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, upper, lower), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark, letters
  ) GROUP BY item_id, term
),
n AS (SELECT doc_id, count(*) AS n FROM dt GROUP BY doc_id),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM n),
tf AS (SELECT doc_id, term, count(*) AS tf FROM dt WHERE term IN (SELECT term FROM qt) GROUP BY doc_id, term),
w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, total GROUP BY term),
gain AS (
  SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms))) AS gain
  FROM tf JOIN n USING (doc_id) JOIN w USING (term), total
),
score AS (SELECT item_id, doc_id, sum(gain * times)::BIGINT AS score FROM qt JOIN gain USING (term) GROUP BY item_id, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM score WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
