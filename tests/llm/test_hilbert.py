import itertools
import zlib
from collections import Counter, defaultdict

import numpy as np

from crystalspark.llm import hilbert_shards as hs
from crystalspark.llm.common import new_path


def test_curve_visits_neighbours():
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        index = hs.hilbert_index(cells, bits)
        assert sorted(index) == list(range(len(cells)))
        walk = cells[np.argsort(index)]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def check(found, rows, law, shards=40):
    assert len(found) == len(rows)
    key = lambda i: -1 if i is None else i
    want = sorted((key(r[0]), len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert sorted((key(r.doc_id), r["size"], r.text_crc32) for r in found) == want
    slots = defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))
    counts = [len(slots[s]) for s in range(shards)]
    if law == "rows":
        assert max(counts) - min(counts) <= 1
    order = [(r.curve, r.text_crc32) for r in sorted(found, key=lambda r: (r.shard, r.slot))]
    assert [c for c, _ in order] == sorted(c for c, _ in order)
    runs = Counter(t for t, _ in itertools.groupby(t for _, t in order))
    assert max(runs.values()) == 1  # equal texts lie together


def test_laws(docs, clashing, no_docs, rows):
    for law in ("rows", "bytes"):
        check(hs.assign(docs, law=law).collect(), rows, law)
        check(hs.assign(docs, law=law, shards=3).collect(), rows, law, 3)
    check(hs.assign(clashing).collect(), rows, "rows")
    assert hs.assign(no_docs).collect() == []


def test_written_shards_and_pruning(spark, docs, rows):
    path = new_path(spark, "test-shards")
    manifest = hs.write_shards(docs, path, shards=6)
    data = spark.read.parquet(path + "/data")
    assert data.count() == len(rows) and {r.rows for r in manifest.collect()} <= {len(rows) // 6, len(rows) // 6 + 1}
    alive = {r.shard for r in hs.prune(manifest, "source", "src2", "src2").collect()}
    assert {r.shard for r in data.where("source = 'src2'").select("shard").distinct().collect()} <= alive


def test_order_along_the_curve(spark, docs, rows):
    """Brute force: cells by quantiles of the numbers, strings by the rows before them; equal texts move to their smallest id's place."""
    import bisect

    found = hs.assign(docs, bits=3).collect()
    columns = []
    for at in (3, 2, None):
        values = [len((r[1] or "").encode()) + 16 if at is None else r[at] for r in rows]
        if at is not None:
            line = sorted(v for v in values if v is not None)
            values = [-1 if v is None else bisect.bisect_left(line, v) for v in values]
        line = sorted(values)
        cuts = sorted({line[max(0, -(-len(line) * i // 8) - 1)] for i in range(1, 8)})
        columns.append([bisect.bisect_right(cuts, v) for v in values])
    own = hs.hilbert_index(np.array(columns).T, 3)
    key = lambda r: (-1 if r[0] is None else r[0], zlib.crc32((r[1] or "").encode()))
    home = {}
    for r, c in zip(rows, own.tolist()):
        home.setdefault(key(r)[1], []).append((key(r)[0], c))
    assert {(k, c): min(v for v in home[c])[1] for k, c in map(key, rows)} == {(-1 if r.doc_id is None else r.doc_id, r.text_crc32): r.curve for r in found}


def test_long_common_beginnings_tell_apart(spark):
    docs = spark.createDataFrame([(i, f"t{i}", f"https://site{i % 9}.org") for i in range(90)], "doc_id long, text string, source string")
    written = hs.materialise(docs.withColumn("size", hs.size_of()), "test-rows")
    numbers = hs.as_numbers(written, {"n": "source"}).select("source", "n").distinct().collect()
    assert sorted((r.source, r.n) for r in numbers) == [(f"https://site{i}.org", 10.0 * i) for i in range(9)]
