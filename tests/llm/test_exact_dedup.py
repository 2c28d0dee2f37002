import hashlib
from collections import defaultdict

from crystalspark.llm import exact_dedup as ed


def check(found, rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    assert len(found) == len(rows)
    by = defaultdict(list)
    for r in found:
        by[r.text_sha256].append(r)
    assert len(by) == len(groups)
    for text, ids in groups.items():
        mine = by[hashlib.sha256(text.encode()).hexdigest()]
        top = max((i for i in ids if i is not None), default=None)
        assert len(mine) == len(ids) and all(r.group_size == len(ids) and r.keep_id == top for r in mine)
        assert [r.doc_id for r in mine if r.kept] == [top]


def test_against_brute_force(docs, clashing, rows, monkeypatch):
    check(ed.exact_duplicates(docs).collect(), rows)
    check(ed.exact_duplicates(clashing).collect(), rows)
    monkeypatch.setattr(ed, "BROADCAST_ROWS", -1)
    check(ed.exact_duplicates(docs).collect(), rows)


def test_empty_table(no_docs):
    assert ed.exact_duplicates(no_docs).collect() == []


def test_equal_prefix_and_length_are_not_enough(spark):
    a = "x" * 100
    rows = [(1, a + "a"), (2, a + "b"), (3, a + "a")]
    found = {r.doc_id: (r.keep_id, r.kept) for r in ed.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: (3, False), 2: (2, True), 3: (3, True)}
