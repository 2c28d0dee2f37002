"""SimHash near-duplicates over BK-trees.

A document's fingerprint is 64 bits of majority votes over the XXH64 values
(seed 42) of its word shingles. Two fingerprints link when at most ``radius``
bits differ. Distinct fingerprints are dealt into shards so that every linked
pair meets in at least one: with radius 3, one of four 16-bit blocks is equal,
and within the other 48 bits one of four 12-bit blocks is equal, which gives
16 keys of 28 bits. Each shard of two or more fingerprints becomes a BK-tree
(children keyed by their integer distance to the parent) and every fingerprint
of the shard walks it, following only edges within the radius. A shard's trees
travel to the task that holds its queries instead of being broadcast whole:
the trees of all fingerprints have no size bound, and one walk over all of
them grows with the square of the corpus.

Each shard hands on one row per linked fingerprint (its local component), not
its pairs, so dense groups stay linear. Components of the whole corpus come
from min-label rounds over those rows, each round a written table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crystalspark.llm.common import delete, materialise, raw

#: Edges walked at once in one task.
BLOCK = 1 << 16


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the 64-bit hashes set."""
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, width: int = 3) -> int:
    """SimHash of UTF-8 bytes; ASCII letters count in lower case."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, 42) if len(words) else 0
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
    begin, end = starts[: len(words) - width + 1].tolist(), (starts + lengths)[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], 42) for a, b in zip(begin, end)), dtype=np.uint64, count=len(begin))
    return majority(hashes)


def fingerprints(docs: DataFrame, text: str = "text", width: int = 3, name: str = "fp") -> DataFrame:
    """Add the signed 64-bit fingerprint column ``name``; null text is empty (fingerprint zero)."""
    kept = docs.withColumn("_raw", raw(text)).drop(text, name)
    schema = kept.drop("_raw").schema.add(name, "long")

    def run(batches):
        for batch in batches:
            values = np.fromiter((fingerprint(x, width) for x in batch.column("_raw").to_pylist()), dtype=np.uint64, count=batch.num_rows)
            at = batch.schema.get_field_index("_raw")
            columns = [c for i, c in enumerate(batch.columns) if i != at]
            names = [n for i, n in enumerate(batch.schema.names) if i != at]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(values.view(np.int64))], names=[*names, name])

    return kept.mapInArrow(run, schema)


class BKForest:
    """BK-trees of several groups at once, kept as flat arrays.

    Trees grow level by level: the elements that wait at a node are split by
    their distance to it, the first of each distance becomes the child on that
    edge and the others wait there.
    """

    def __init__(self, values: np.ndarray, groups: np.ndarray):
        n = len(values)
        self.values = values
        first = np.ones(n, dtype=bool)
        first[1:] = groups[1:] != groups[:-1]
        self.root = np.flatnonzero(first)[np.cumsum(first) - 1]
        parent, edge = np.full(n, -1, dtype=np.int64), np.full(n, -1, dtype=np.int64)
        waiting, at = np.flatnonzero(~first), self.root[~first]
        while len(waiting):
            d = np.bitwise_count(values[waiting] ^ values[at]).astype(np.int64)
            key = at * 65 + d
            order = np.argsort(key, kind="stable")
            waiting, at, d, key = waiting[order], at[order], d[order], key[order]
            new = np.ones(len(key), dtype=bool)
            new[1:] = key[1:] != key[:-1]
            node = waiting[new][np.cumsum(new) - 1]
            parent[waiting[new]], edge[waiting[new]] = at[new], d[new]
            waiting, at = waiting[~new], node[~new]
        has = np.flatnonzero(parent >= 0)
        order = np.argsort(parent[has] * 65 + edge[has], kind="stable")
        self.children = has[order]
        self.keys = parent[self.children] * 65 + edge[self.children]

    def search(self, radius):
        """Yield blocks (a, b) of indices linked within a's radius (a number, or one an element), a before b in its group."""
        radius = np.broadcast_to(np.asarray(radius, dtype=np.int64), len(self.values))
        n, stack = len(self.values), []
        for at in range(0, n, BLOCK):
            query = np.arange(at, min(n, at + BLOCK))
            todo = query, self.root[query]
            while todo is not None:
                query, node = todo
                d = np.bitwise_count(self.values[query] ^ self.values[node]).astype(np.int64)
                reach = radius[query]
                hit = (d <= reach) & (query < node)
                if hit.any():
                    yield query[hit], node[hit]
                low = np.searchsorted(self.keys, node * 65 + np.maximum(d - reach, 0))
                count = np.searchsorted(self.keys, node * 65 + np.minimum(d + reach, 64), side="right") - low
                live = np.flatnonzero(count)
                if len(live):
                    stack.append((query[live], low[live], count[live]))
                todo = self._next(stack)

    def _next(self, stack: list):
        """(query, node) of the next edges, BLOCK at most; edges not walked yet wait as ranges, so a level of a wide tree is never held whole."""
        if not stack:
            return None
        query, low, count = stack.pop()
        upto = np.cumsum(count)
        k = max(1, int(np.searchsorted(upto, BLOCK, side="right")))
        if k < len(query):
            stack.append((query[k:], low[k:], count[k:]))
        count, upto = count[:k], upto[:k]
        offsets = np.arange(upto[-1]) - np.repeat(upto - count, count)
        return np.repeat(query[:k], count), self.children[np.repeat(low[:k], count) + offsets]


def local_components(n: int, blocks) -> np.ndarray:
    """Smallest index that links reach, for each of n elements."""
    label = np.arange(n)
    for a, b in blocks:
        while True:
            la, lb = label[a], label[b]
            differ = la != lb
            if not differ.any():
                break
            high, low = np.maximum(la, lb)[differ], np.minimum(la, lb)[differ]
            np.minimum.at(label, high, low)
            while True:
                shorter = label[label]
                if (shorter == label).all():
                    break
                label = shorter
    return label


def shard_keys(fp: str = "fp") -> list:
    """The 16 shard keys of a fingerprint: an equal 16-bit block and, in the other 48 bits, an equal 12-bit block."""
    value, keys = F.col(fp), []
    for block in range(4):
        outer = F.shiftrightunsigned(value, 16 * block).bitwiseAND(0xFFFF)
        rest = [b for b in range(64) if not 16 * block <= b < 16 * block + 16]
        for part in range(4):
            bits = rest[12 * part : 12 * part + 12]
            inner, at = F.lit(0).cast("long"), 0
            while at < 12:  # runs of neighbouring bits move together
                run = 1
                while at + run < 12 and bits[at + run] == bits[at] + run:
                    run += 1
                inner = inner.bitwiseOR(F.shiftleft(F.shiftrightunsigned(value, bits[at]).bitwiseAND((1 << run) - 1), at))
                at += run
            keys.append(F.lit(block * 4 + part).cast("long") * F.lit(1 << 28) + F.shiftleft(outer, 12) + inner)
    return keys


def shard_links(distinct: DataFrame, radius: int = 3) -> DataFrame:
    """(fp, rep) for each fingerprint that a shard links to a smaller one of its local component."""
    if radius > 3:
        raise ValueError("the shard keys guarantee recall up to radius 3")
    keyed = distinct.select("fp", F.explode(F.array(*shard_keys())).alias("shard"))
    shared = keyed.groupBy("shard").agg(F.count("*").alias("_n")).where("_n > 1").select("shard")
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = keyed.join(shared, "shard").repartition(parts, "shard").sortWithinPartitions("shard", "fp")

    def flush(shards: np.ndarray, fps: np.ndarray):
        keep = np.ones(len(fps), dtype=bool)
        keep[1:] = (shards[1:] != shards[:-1]) | (fps[1:] != fps[:-1])
        shards, fps = shards[keep], fps[keep]
        forest = BKForest(fps.view(np.uint64), shards)
        label = local_components(len(fps), forest.search(radius))
        moved = label != np.arange(len(fps))
        return pa.RecordBatch.from_arrays([pa.array(fps[moved]), pa.array(fps[label[moved]])], names=["fp", "rep"])

    def run(batches):
        shards, fps = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            shards = np.concatenate([shards, batch.column("shard").to_numpy(zero_copy_only=False)])
            fps = np.concatenate([fps, batch.column("fp").to_numpy(zero_copy_only=False)])
            if len(fps) and shards[0] != shards[-1]:  # the last shard may go on in the next batch
                cut = int(np.searchsorted(shards, shards[-1]))
                yield flush(shards[:cut], fps[:cut])
                shards, fps = shards[cut:], fps[cut:]
        if len(fps):
            yield flush(shards, fps)

    return met.select("shard", "fp").mapInArrow(run, "fp long, rep long").distinct()


def components(edges: DataFrame, a: str = "fp", b: str = "rep", label: str = "simhash") -> DataFrame:
    """(node, root) of every node on an edge, root the smallest node reached.

    Alternates large-star and small-star rounds (Kiveris et al., 2014); each
    round is a written table, and only a round's count and sum reach the driver.
    """
    spark = edges.sparkSession
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    pairs = materialise(pairs, f"{label}-cc")
    previous = None
    while True:
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        after = materialise(small, f"{label}-cc")
        state = after.agg(F.count("*"), F.sum(F.col("v").cast("decimal(38,0)")), F.sum(F.col("u").cast("decimal(38,0)"))).first()
        for path in {f.rsplit("/", 1)[0] for f in pairs.inputFiles()}:
            delete(spark, path)
        pairs = after
        if tuple(state) == previous:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
        previous = tuple(state)


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 3, radius: int = 3) -> DataFrame:
    """``docs`` without its text, plus ``fp`` (signed 64-bit) and ``component_id``.

    Nulls and texts without words have fingerprint zero and link like any
    other. Repeated rows share a fingerprint and so a component; every input
    row returns once. A component takes its smallest doc_id (nulls last; null
    when all its ids are null). An empty table returns no rows. Other columns
    pass through; columns named fp or component_id are replaced.
    """
    marked = materialise(fingerprints(docs.drop("component_id"), text, width), "simhash-fp")
    distinct = materialise(marked.groupBy("fp").agg(F.min(doc_id).alias("_least")), "simhash-classes")
    roots = components(shard_links(distinct, radius))
    joined = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "_least", F.coalesce("root", "fp").alias("_root"))
    least = joined.groupBy("_root").agg(F.min("_least").alias("component_id"))
    by_fp = joined.join(least, "_root").select("fp", "component_id")
    return marked.join(by_fp, "fp")
