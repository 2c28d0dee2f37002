import hashlib
import random
from collections import defaultdict

import numpy as np

from crystalspark.llm import repeated_substrings as rs


def brute(texts, length):
    """(n_removed, n_spans, sha256 of the rest) of each text."""
    starts = defaultdict(list)
    for i, t in enumerate(texts):
        for p in range(len(t) - length + 1):
            starts[t[p : p + length]].append((i, p))
    gone = [np.zeros(len(t), dtype=bool) for t in texts]
    for places in starts.values():
        if len(places) > 1:
            for i, p in places:
                gone[i][p : p + length] = True
    out = []
    for t, g in zip(texts, gone):
        spans = int((np.diff(np.concatenate(([0], g.astype(int)))) == 1).sum())
        out.append((int(g.sum()), spans, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~g])).hexdigest()))
    return out


def check(found, rows, length):
    want = brute([(r[1] or "").encode() for r in rows], length)
    key = lambda i: -1 if i is None else i
    assert sorted((key(r.doc_id), r.n_removed, r.n_spans, r.kept_sha256) for r in found) == sorted((key(r[0]), *w) for r, w in zip(rows, want))
    assert any(w[0] for w in want)


def planted(seed):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("abcdeéß ") for _ in range(n))
    passages = [word(n) for n in (399, 400, 401, 520, 900)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.randint(1, 4)):
            parts.append(word(rng.randint(0, 300)))
            p = rng.choice(passages)
            a = rng.randint(0, 30) if rng.random() < 0.5 else 0
            parts.append(p[a : len(p) - (rng.randint(0, 30) if rng.random() < 0.5 else 0)])
            if rng.random() < 0.2:  # an edit inside a passage
                k = rng.randrange(max(1, len(parts[-1])))
                parts[-1] = parts[-1][:k] + "#" + parts[-1][k + 1 :]
        rows.append((i, "".join(parts)))
    rows += [(100, "x" * 1500), (101, "ab" * 450), (102, rows[3][1]), (103, None), (104, ""), (105, "y" * 400), (106, "z" * 399), (107, word(150) * 6), (None, rows[5][1]), (3, rows[3][1])]
    return rows


def test_planted_passages(spark):
    rows = planted(1)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    check(rs.remove_repeats(df).collect(), rows, 400)


def test_short_length_and_odd_tables(docs, clashing, no_docs, rows):
    check(rs.remove_repeats(docs, length=60, gram=24).collect(), rows, 60)
    found = rs.remove_repeats(clashing, length=60, gram=24, keep_text=True).collect()
    check(found, rows, 60)
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in found)
    assert rs.remove_repeats(no_docs).collect() == []


def test_long_texts_are_cut_into_segments(spark, monkeypatch):
    rng = random.Random(2)
    body = bytes(rng.choice(b"abcd") for _ in range(5000))
    values = rs._byte_values()
    whole = rs.anchors(body, 400, 160, values)
    monkeypatch.setattr(rs, "SEGMENT", 700)
    parts = rs.anchors(body, 400, 160, values)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


def test_columns_give_the_sorted_order_and_prefixes(tmp_path):
    rng = random.Random(4)
    pieces = [(g, rng.randint(0, 3), bytes(rng.choice(b"ab") for _ in range(9))) for g in range(3) for _ in range(7)]
    builder = rs.ColumnwiseBuilder(f"file://{tmp_path}/build", 12)
    for _, c, p in pieces:
        builder.add(p, c)
    groups = np.array([g for g, _, _ in pieces])
    rows = [[0] * c + [x + 1 for x in p] + [0] * (12 - c - len(p)) for _, c, p in pieces]
    for column, order, shared in builder.rounds(groups):
        for k in range(1, len(order)):
            a, b = order[k - 1], order[k]
            assert groups[a] <= groups[b]
            n = 0
            while groups[a] == groups[b] and column + n < 12 and rows[a][column + n] == rows[b][column + n] != 0:
                n += 1
            assert shared[k] == n
    builder.close()


def test_hot_anchors_are_split(spark, monkeypatch):
    monkeypatch.setattr(rs, "HOT", 3)
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcd ") for _ in range(n))
    line, passage = word(230), word(700)
    rows = planted(3) + [(200 + i, word(rng.randint(0, 500)) + line + word(rng.randint(0, 500))) for i in range(40)]
    rows += [(300 + i, word(50) + passage[:i * 17] + "#" + passage[i * 17:] + word(90)) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    check(rs.remove_repeats(df).collect(), rows, 400)


def test_pieces_of_a_common_line_are_grouped_in_proportion(spark, monkeypatch):
    """Five times the documents around a common line give about five times the grouped pieces."""
    rng = random.Random(12)
    word = lambda n: "".join(rng.choice("abcd ") for _ in range(n))
    line, made, groups = word(260), [], rs._context_groups
    monkeypatch.setattr(rs, "_context_groups", lambda *a: made.append(groups(*a).count()) or groups(*a))
    for n in (500, 2500):
        rows = [(i, word(300) + line + word(300)) for i in range(n)] + [(-1, "x" * 500), (-2, "x" * 450)]
        made.append(0)
        found = rs.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
        assert sorted(r.doc_id for r in found if r.n_removed) == [-2, -1]
    few, many = made[1 : made.index(0, 1)], made[made.index(0, 1) + 1 :]
    assert 0 < sum(few) and sum(many) <= 6 * sum(few)
