"""Near copies by SimHash BK-trees: groups of texts whose word shingles have a Jaccard similarity of at least a bound.

A text is the set of the XXH64 values (seed 42) of its word shingles, and the
SimHash of these values is its fingerprint. At this similarity fingerprints
differ in ten bits on average, too many for shards named by equal bits. Shards
are therefore named by shingles: sets are ordered by hash, and two sets that
are similar enough share a value in their first few (prefix filter: of sizes
m <= n, the first m - ceil(2t/(1+t) m) + 1 and the first n - ceil(t n) + 1 for
similarity t), so every linked pair meets in a shard. In each shard a BK-tree
of the fingerprints is walked within ``RADIUS`` bits, one for each band of
sizes and the next. What it finds passes an exact bound from 512 parity bits a
set, has to share enough shards (of the k first values of the smaller set, four
fifths on average, ``SHY`` deviations less at least), and every link is then
checked on the whole texts.

Fingerprints of sets at the bound differ in 9.7 bits with a deviation of 2.9,
so ``RADIUS`` loses less than two links in 10^5 of those just at the bound, and
fewer above it; sets of fewer than ``SMALL`` shingles, whose bits vary more,
meet without a radius and lose none.

Dense groups do not become all their pairs: first every set meets only the few
neighbours it shares most values with, then in two rounds the trees of a shard give
each component its nearest other one, and once those links are followed, all
pairs that still lie in different components.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from crystalspark.llm.common import delete, materialise, raw
from crystalspark.llm.simhash_bktree import BKForest, components, majority

#: Bits that the fingerprints of a linked pair may differ in; shingles of a set that is searched without it.
RADIUS, SMALL = 22, 64
#: Deviations that the number of shards a pair shares may stay below its mean.
SHY = 5
#: Longs of parity bits of a set; buckets of its counts.
LONGS, BUCKETS = 8, 512
BITS = [f"s{i}" for i in range(LONGS)]
#: Neighbours a set is compared with before components are followed; the second round looks at all others.
FIRST = 2
#: Pairs that a shard holds or hands on in one go.
PAIRS = 1 << 17
#: Shingles of the pairs checked in one go, and bytes of sets held meanwhile.
CELL, HELD = 1 << 21, 64 << 20


def _drop(df: DataFrame) -> None:
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        delete(df.sparkSession, path)


def pressed(texts: DataFrame) -> DataFrame:
    """(row, raw) with raw compressed, as it travels through joins."""

    def run(batches):
        press = zstandard.ZstdCompressor()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array([press.compress(x) for x in batch.column("raw").to_pylist()], pa.binary())], names=["row", "raw"])

    return texts.select("row", "raw").mapInArrow(run, "row long, raw binary")


def shingles(text: bytes, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; ASCII letters count in lower case, a shorter text is one shingle."""
    words = text.lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
    width = min(width, len(words))
    begin, end = starts[: len(words) - width + 1].tolist(), (starts + lengths)[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], 42) for a, b in zip(begin, end)), dtype=np.uint64, count=len(begin)))


def parity(values: np.ndarray) -> np.ndarray:
    """Whether each of the 64 * LONGS classes holds an odd number of the hashes, as longs."""
    odd = np.bincount((values >> np.uint64(32)).astype(np.int64) % (64 * LONGS), minlength=64 * LONGS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def describe(rows: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """(row, key, n, fingerprint, parity bits, prefix, near) of rows with ``row`` and ``raw``; the first ``near`` of the prefix serve the smaller set."""
    schema = "row long, key long, n long, fp long, " + ", ".join(f"{s} long" for s in BITS) + ", prefix array<long>, near int"

    def run(batches):
        for batch in batches:
            keys, sizes, marks, bits, prefixes, nears = [], [], [], [], [], []
            for body in batch.column("raw").to_pylist():
                values = shingles(body, width)
                n = len(values)
                keys.append(xxhash.xxh64_intdigest(values.tobytes(), 42))
                sizes.append(n)
                marks.append(majority(values))
                bits.append(parity(values))
                prefixes.append(values[: n + (-num * n) // den + 1].view(np.int64))
                nears.append(n + (-2 * num * n) // (num + den) + 1)
            bits = np.array(bits).reshape(len(keys), LONGS)
            columns = [batch.column("row"), pa.array(np.array(keys, dtype=np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(np.array(marks, dtype=np.uint64).view(np.int64))]
            columns += [pa.array(np.ascontiguousarray(bits[:, i]), pa.int64()) for i in range(LONGS)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(prefixes, pa.list_(pa.int64())), pa.array(nears, pa.int32())], names=["row", "key", "n", "fp", *BITS, "prefix", "near"])

    return rows.select("row", "raw").mapInArrow(run, schema)


def tree_pairs(met: DataFrame, num: int, den: int, one: bool) -> DataFrame:
    """(a, b, cell) of sets that the tree of a shard links across components, and one such shard; sizes, prefixes and parity bits allow the similarity.

    With ``one``, a shard gives each component its nearest pair only.
    """
    parts = int(met.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = ["shingle", "key", "n", "near", "comp", "fp", *BITS]
    dealt = met.select(*names).repartition(parts, "shingle").sortWithinPartitions("shingle", "n", "key")

    def flush(t: dict):
        shingle, key, n, near, comp, fp = (t[c] for c in names[:6])
        bits = np.stack([t[s] for s in BITS], axis=1)
        # sizes of a linked pair lie in one band or in neighbouring ones: group g holds bands g and g + 1
        band = np.floor(np.log(np.maximum(n, 1)) / np.log(den / num) + 1e-9).astype(np.int64)
        of, group = np.tile(np.arange(len(n)), 2), np.concatenate([band, band - 1])
        order = np.lexsort((of, group, shingle[of]))
        of, group = of[order], group[order]
        fresh = np.ones(len(of), dtype=bool)
        fresh[1:] = (group[1:] != group[:-1]) | (shingle[of[1:]] != shingle[of[:-1]])

        def blocks():
            forest = BKForest(fp.view(np.uint64)[of], np.cumsum(fresh))
            for i, j in forest.search(np.where(n < SMALL, 64, RADIUS)[of]):  # the smaller set of a pair comes first
                first = band[of[i]] == group[i]
                i, j = of[i[first]], of[j[first]]
                able = near[i] & (comp[i] != comp[j]) & (n[j] * num <= n[i] * den)
                a, b = i[able], j[able]
                apart = np.bitwise_count((bits[a] ^ bits[b]).view(np.uint64)).sum(axis=1, dtype=np.int64)
                hit = apart * (num + den) <= (den - num) * (n[a] + n[b])
                if hit.any():
                    yield a[hit], b[hit]

        def nearest(a, b):
            away = np.bitwise_count((fp[a] ^ fp[b]).view(np.uint64))
            side, pair = np.concatenate([comp[a], comp[b]]), np.tile(np.arange(len(a)), 2)
            best = np.lexsort((away[pair], side, shingle[a[pair]]))
            side, shard = side[best], shingle[a[pair[best]]]
            keep = np.unique(pair[best][np.append(True, (side[1:] != side[:-1]) | (shard[1:] != shard[:-1]))])
            return a[keep], b[keep]

        def kept():
            most = PAIRS
            held, size = [], 0
            for a, b in blocks():
                held.append((a, b))
                size += len(a)
                if size > most:
                    held = [nearest(*map(np.concatenate, zip(*held)))]
                    size = len(held[0][0])
                    most = PAIRS + 2 * size
            if held:
                yield nearest(*map(np.concatenate, zip(*held)))

        for a, b in kept() if one else blocks():
            for at in range(0, len(a), PAIRS):
                x, y = a[at : at + PAIRS], b[at : at + PAIRS]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(key[x], key[y])), pa.array(np.maximum(key[x], key[y])), pa.array(shingle[x]), pa.array(n[x])], names=["a", "b", "cell", "m"])

    def run(batches):
        held = None
        for batch in batches:
            new = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names}
            held = new if held is None else {c: np.concatenate([held[c], new[c]]) for c in names}
            at = held["shingle"]
            if len(at) and at[0] != at[-1]:  # the last shingle may go on in the next batch
                cut = int(np.searchsorted(at, at[-1]))
                yield from flush({c: v[:cut] for c, v in held.items()})
                held = {c: v[cut:] for c, v in held.items()}
        if held is not None and len(held["shingle"]):
            yield from flush(held)

    pairs = dealt.mapInArrow(run, "a long, b long, cell long, m long").groupBy("a", "b").agg(F.min("cell").alias("cell"), F.count("*").alias("_n"), F.max("m").alias("m"))
    if one:
        return pairs.select("a", "b", "cell")
    first = F.col("m") - F.ceil(F.col("m") * (2 * num) / (num + den)) + 1
    share = F.lit(num / den)
    return pairs.where(F.col("_n") >= share * first - SHY * F.sqrt(share * (1 - share) * first)).select("a", "b", "cell")


def verified(pairs: DataFrame, sets: DataFrame, texts: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """The (a, b) of ``pairs`` (a, b, cell) whose whole texts are similar enough; ``texts`` has row and raw.

    The pairs of a cell are checked together, so that a text travels once to
    all pairs it has there; a cell with many pairs becomes a square of cells.
    """
    spark = pairs.sparkSession
    side = lambda s: sets.select(F.col("key").alias(s), F.col("n").alias(f"n{s}"), F.col("row").alias(f"r{s}"), F.col("fp").alias(f"fp{s}"), *[F.col(x).alias(f"{x}{s}") for x in BITS])
    apart = sum((F.bit_count(F.col(f"{x}a").bitwiseXOR(F.col(f"{x}b"))) for x in BITS), F.lit(0))
    size = F.col("na") + F.col("nb")
    reach = (F.bit_count(F.col("fpa").bitwiseXOR(F.col("fpb"))) <= RADIUS) | (F.least("na", "nb") < SMALL)
    near = pairs.join(side("a"), "a").join(side("b"), "b").where(reach & (apart * (num + den) <= (den - num) * size)).select("a", "b", "cell", "ra", "rb", size.alias("n"))
    near = materialise(near, "copies-pairs")
    ways = near.groupBy("cell").agg(F.ceil(F.sqrt(F.sum("n") / F.lit(CELL))).alias("ways"))
    part = lambda c: F.pmod(F.xxhash64(c), F.col("ways"))
    placed = near.join(ways, "cell").select("a", "b", "ra", "rb", F.xxhash64("cell", part("a"), part("b")).alias("cell"))
    used = placed.select("cell", F.col("a").alias("key"), F.col("ra").alias("row")).union(placed.select("cell", "b", "rb")).distinct()
    bodies = materialise(pressed(texts.join(near.select(F.col("ra").alias("row")).union(near.select("rb")).distinct(), "row", "left_semi")), "copies-texts")
    none = F.lit(None)
    sent = used.join(bodies, "row").select("cell", F.lit(0).alias("kind"), F.col("key").alias("a"), none.cast("long").alias("b"), "raw")
    met = sent.union(placed.select("cell", F.lit(1), "a", "b", none.cast("binary")))
    met = met.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "cell").sortWithinPartitions("cell", "kind", "b", "a")

    def run(batches):
        press, here, packed, sets_, held = zstandard.ZstdDecompressor(), None, {}, {}, 0
        for batch in batches:
            found = []
            for cell, kind, a, b, body in zip(*(batch.column(c).to_pylist() for c in ("cell", "kind", "a", "b", "raw"))):
                if cell != here:
                    here, packed, sets_, held = cell, {}, {}, 0
                if kind == 0:
                    packed[a] = body
                    continue
                for key in (a, b):
                    if key not in sets_:
                        if held > HELD:
                            sets_, held = {k: v for k, v in sets_.items() if k in (a, b)}, 0
                        values = shingles(press.decompress(packed[key]), width)
                        sets_[key] = values, np.bincount((values >> np.uint64(32)).astype(np.int64) % BUCKETS, minlength=BUCKETS)
                        held += sum(x.nbytes for x in sets_[key])
                (x, xs), (y, ys) = sets_[a], sets_[b]
                least = num * (len(x) + len(y))
                if np.minimum(xs, ys).sum() * (num + den) < least:
                    continue
                place = np.minimum(np.searchsorted(y, x), len(y) - 1)
                if int((y[place] == x).sum()) * (num + den) >= least:
                    found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])

    links = materialise(met.mapInArrow(run, "a long, b long"), "copies-links")
    _drop(near)
    _drop(bodies)
    return links


def groups(docs: DataFrame, row: str, text: str = "text", width: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """(row, root) of every row: rows of one root are linked by texts of similarity ``num / den`` or more.

    ``row`` names a column that tells rows apart. Null texts and texts without
    words are one group. ``docs`` is read several times and should be written.
    """
    texts = docs.select(F.col(row).alias("row"), raw(text).alias("raw"))
    if docs.isEmpty():
        return texts.select("row", F.lit(None).cast("long").alias("root"))
    marked = materialise(describe(texts, width, num, den), "copies-sets")
    sets = marked.groupBy("key").agg(F.min("row").alias("row"), *[F.first(c).alias(c) for c in ("n", "fp", *BITS, "prefix", "near")])
    sets, wide = materialise(sets, "copies-distinct"), marked
    marked = materialise(wide.select("row", "key"), "copies-rows")
    _drop(wide)
    items = sets.select("key", "n", "near", F.posexplode("prefix").alias("pos", "shingle")).select("shingle", "key", "n", (F.col("pos") < F.col("near")).alias("near"))
    order = W.partitionBy("shingle").orderBy("n", "key")
    beside = lambda f: f(F.struct("key", "n")).over(order)
    met = items.withColumns({"_before": beside(F.lag), "_first": beside(F.first), "_after": F.lead("key").over(order)})
    met = materialise(met.where("_before IS NOT NULL OR _after IS NOT NULL").drop("_after"), "copies-met")
    alike = lambda c: met.where(F.col(f"{c}.key") != F.col("key")).where(F.col("n") * num <= F.col(f"{c}.n") * den).select(F.least("key", f"{c}.key").alias("a"), F.greatest("key", f"{c}.key").alias("b"), "shingle")
    both = alike("_before").union(alike("_first")).groupBy("a", "b").agg(F.count("*").alias("_n"), F.min("shingle").alias("cell"))
    most = W.partitionBy("b").orderBy(F.col("_n").desc(), "a")
    tried = materialise(both.withColumn("_at", F.row_number().over(most)).where(F.col("_at") <= FIRST).select("a", "b", "cell"), "copies-tried")
    links = verified(tried, sets, texts, width, num, den)
    roots = components(links, "a", "b", "copies")
    for one in (True, True, False):
        named = met.select("shingle", "key", "n", "near").join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("comp", F.coalesce("root", "key"))
        open_ = named.groupBy("shingle").agg(F.min("comp").alias("_low"), F.max("comp").alias("_high")).where("_low <> _high").select("shingle")
        named = named.join(open_, "shingle").join(sets.select("key", "fp", *BITS), "key")
        fresh = materialise(tree_pairs(named, num, den, one).join(tried.select("a", "b"), ["a", "b"], "left_anti"), "copies-fresh")
        more = verified(fresh, sets, texts, width, num, den)
        tried = tried.select("a", "b").union(fresh.select("a", "b"))
        if not more.isEmpty():
            links = links.union(more)
            roots = components(links, "a", "b", "copies")
    for done in (sets, met, tried):
        _drop(done)
    return marked.select("row", "key").join(roots.withColumnRenamed("node", "key"), "key", "left").select("row", F.coalesce("root", "key").alias("root"))
