import random
import tracemalloc

import numpy as np
import xxhash

from crystalspark.llm import simhash_bktree as sh


def slow_fingerprint(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def brute(pairs, radius=3):
    """Smallest id reachable for each (id, fp)."""
    fps = sorted({f for _, f in pairs})
    label = {f: f for f in fps}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if bin(a ^ b).count("1") <= radius:
                label[find(a)] = find(b)
    least = {}
    for d, f in pairs:
        if d is not None:
            least[find(f)] = min(d, least.get(find(f), d))
    return {f: least.get(find(f)) for f in fps}


def test_documents(docs, no_docs, clashing, rows):
    pairs = [(r[0], slow_fingerprint(r[1])) for r in rows]
    want = brute(pairs)
    for source in (docs, clashing):
        found = sh.near_duplicates(source).collect()
        got = sorted((-1 if r.doc_id is None else r.doc_id, r.fp % 2**64, r.component_id) for r in found)
        assert got == sorted((-1 if d is None else d, f, want[f]) for d, f in pairs)
    assert sh.near_duplicates(no_docs).collect() == []


def test_links_and_chains(spark):
    rng = random.Random(3)
    fps = []
    for _ in range(60):
        f = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            fps.append(f)
            for _ in range(rng.randint(1, 4)):
                f ^= 1 << rng.randrange(64)
    signed = [f - 2**64 if f >= 2**63 else f for f in sorted(set(fps))]
    links = sh.shard_links(spark.createDataFrame([(f,) for f in signed], "fp long"))
    roots = {r.node % 2**64: r.root % 2**64 for r in sh.components(links).collect()}
    want = brute([(f, f) for f in set(fps)])
    groups = {}
    for f in set(fps):
        groups.setdefault(want[f], set()).add(roots.get(f, f))
    assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)


def test_tree_search_is_exact():
    rng = np.random.default_rng(5)
    values = rng.integers(0, 2**63, 400, dtype=np.uint64)
    values[200:] = values[:200] ^ (np.uint64(1) << rng.integers(0, 64, 200, dtype=np.uint64))
    values = np.unique(values)
    groups = np.sort(rng.integers(0, 3, len(values)))
    found = {(int(a), int(b)) for x, y in sh.BKForest(values, groups).search(3) for a, b in zip(x, y)}
    want = {(i, j) for j in range(len(values)) for i in range(j) if groups[i] == groups[j] and np.bitwise_count(values[i] ^ values[j]) <= 3}
    assert found == want


def test_whole_pairs_meet_in_a_shard(spark):
    rng = random.Random(9)
    rows = []
    for i in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(1, 3)):
            b ^= 1 << bit
        rows += [(i, x - 2**64 if x >= 2**63 else x) for x in (a, b)]
    from pyspark.sql import functions as F

    keyed = spark.createDataFrame(rows, "i long, fp long").select("i", "fp", F.explode(F.array(*sh.shard_keys())).alias("k"))
    assert keyed.groupBy("i", "k").agg(F.countDistinct("fp").alias("n")).where("n = 2").select("i").distinct().count() == 300


def test_a_wide_tree_is_walked_in_bounded_blocks(monkeypatch):
    monkeypatch.setattr(sh, "BLOCK", 1 << 10)
    rng = np.random.default_rng(5)
    values, asked = rng.integers(0, 1 << 63, 3000, dtype=np.uint64), []
    forest = sh.BKForest(values, np.zeros(len(values), dtype=np.int64))
    count = np.bitwise_count
    monkeypatch.setattr(sh.np, "bitwise_count", lambda x: asked.append(len(x)) or count(x))
    found = sorted((int(a), int(b)) for block in forest.search(22) for a, b in zip(*block))
    monkeypatch.undo()
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= 22
    assert found == sorted(zip(*(x.tolist() for x in np.nonzero(np.triu(near, 1)))))
    assert max(asked) <= 1 << 10
    tracemalloc.start()
    forest = sh.BKForest(rng.integers(0, 1 << 63, 6000, dtype=np.uint64), np.zeros(6000, dtype=np.int64))
    for _ in forest.search(40):
        pass
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 40 << 20
