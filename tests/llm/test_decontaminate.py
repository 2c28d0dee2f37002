import re

from pyspark.sql import types as T

from crystalspark.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEMS = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType())])


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, n=10):
    w, hit, found = words(text), set(), set()
    for i, t in items:
        b = words(t)
        size = min(n, len(b))
        for k in range(len(b) - size + 1) if size else ():
            for p in range(len(w) - size + 1):
                if w[p : p + size] == b[k : k + size]:
                    hit |= set(range(p, p + size))
                    if i is not None:
                        found.add(str(i))
    return len(w), len(hit), sorted(found)


def items(rows):
    long = rows[2][1].split()
    while len(long) < 40:
        long += rows[8][1].split()
    return [(3, " ".join(long[3:30])), (20, "ONE, two"), (100, rows[10][1]), (100, rows[12][1]), (5, None), (6, ""), (7, "!!"), (None, rows[20][1])]


def test_against_brute_force(spark, docs, rows):
    its = items(rows)
    bench = spark.createDataFrame(its, ITEMS)
    for block in (8 << 20, 300):
        found = dc.scan(docs, bench, block_bytes=block).collect()
        assert len(found) == len(rows)
        got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_hit, r["items"], sum(s["last"] - s["first"] for s in r.spans)) for r in found)
        want = []
        for r in rows:
            n, h, f = brute(r[1], its)
            want.append((-1 if r[0] is None else r[0], n, h, f, h))
        assert got == sorted(want)
        assert any(h for _, _, h, _, _ in got)


def test_removal(spark, docs, rows):
    bench = spark.createDataFrame(items(rows), ITEMS)
    kept = dc.decontaminate(docs, bench)
    assert kept.columns == docs.columns
    assert kept.count() == sum(not brute(r[1], items(rows))[1] for r in rows)
    cut = dc.decontaminate(docs, bench, remove="spans")
    assert cut.columns == docs.columns and cut.count() == len(rows)
    assert dc.scan(cut.where("doc_id = 10"), bench).first().n_words < len(words(rows[10][1]))


def test_clashes_and_empty_tables(spark, docs, no_docs, clashing, rows):
    bench = spark.createDataFrame(items(rows), ITEMS)
    assert dc.scan(no_docs, bench).count() == 0
    assert dc.scan(docs, spark.createDataFrame([], ITEMS)).where("n_hit > 0").count() == 0
    a = dc.scan(clashing, bench).select("doc_id", "n_hit").toPandas().n_hit.sum()
    assert a == dc.scan(docs, bench).toPandas().n_hit.sum()


def test_many_items_share_a_window():
    common = " ".join(f"c{i}" for i in range(12)).encode()
    windows = dc.WindowSet([(str(k), common + f" own{k}".encode()) for k in range(50)], 10)
    spans, found = windows.scan(dc.words_of(b"x " + common + b" y " + common))
    assert spans == [(1, 13), (14, 26)] and found == {str(k) for k in range(50)}
