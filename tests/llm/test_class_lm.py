import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from crystalspark.llm import class_lm as lm
from crystalspark.llm.common import crc_mod, raw


def toks(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split() + [b""]


def held(doc_id):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


def fitted(docs):
    """The model and the class of any word."""
    model, table = lm.fit(docs.select(raw("text").alias("raw")))
    table = {bytes(r.word): (r["class"], r.c) for r in table.collect()}
    of = lambda w: 0 if w == b"" else (model.common.get(w) or table.get(w) or (int(model.group_class[lm.ending(w)]), 0))[0]
    return model, table, of


def bigrams(texts, of, classes):
    pairs = np.zeros((classes, classes))
    for t in texts:
        line = [0, *map(of, t)]
        for a, b in zip(line, line[1:]):
            pairs[a, b] += 1
    return pairs


def test_against_brute_force(docs, clashing, rows, monkeypatch):
    train = crc_mod("doc_id", 7) != 2
    for common in (lm.COMMON, 20):
        monkeypatch.setattr(lm, "COMMON", common)
        found = lm.score(docs, train).collect()
        texts = [toks(r[1]) for r in rows if not held(r[0])]
        counts = Counter(w for t in texts for w in t)
        n, v = sum(counts.values()), len(counts)
        model, table, of = fitted(docs.where(train))
        assert (model.total, model.distinct, model.ends) == (n, v, len(texts))
        assert all(c == counts[w] for w, (_, c) in {**table, **model.common}.items())
        once = np.zeros(model.classes)
        for k, c in table.values():
            once[k] += c == 1
        transition, known, unknown = lm.probabilities(bigrams(texts, of, model.classes), once)
        want = []
        for r in rows:
            t = toks(r[1])
            base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t)
            before, total = 0, 0.0
            for w in t:
                k = of(w)
                total += transition[before, k] + (known[k] + math.log10(counts[w]) if counts[w] else unknown[k])
                before = k
            want.append((-1 if r[0] is None else r[0], len(t), sum(counts[w] > 0 for w in t), n, round(base, 6), round(total, 6)))
        got = [(-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in found]
        assert sorted(got) == sorted(want)
    assert len(lm.score(clashing, train).collect()) == len(rows)


def test_rare_words_join_the_class_that_gains_most(docs, rows, monkeypatch):
    monkeypatch.setattr(lm, "SHARE", 1 / 64)  # leaves most words outside the core
    texts = docs.select(raw("text").alias("raw"))
    units = {w: i + 1 for i, w in enumerate([b"a", b"b"])}
    label = np.random.default_rng(2).integers(1, 6, 1 + len(units) + lm.GROUPS)
    label[0] = 0
    group = label[1 + len(units) :]
    first = lambda w: 0 if w == b"" else int(label[units[w]]) if w in units else int(group[lm.ending(w)])
    lines = [toks(r[1]) for r in rows]
    pairs = bigrams(lines, first, 6)
    found = {bytes(r.word): (r.c, r["class"]) for r in lm.join_classes(lm.neighbours(texts, units, label, 6), pairs, group).collect()}
    counts, before, after = Counter(w for t in lines for w in t), Counter(), Counter()
    for t in lines:
        line = [b"", *t, b""]
        for x, w, y in zip(line, line[1:], line[2:]):
            before[w, first(x)] += 1
            after[w, first(y)] += 1
    log = lambda x: math.log(x + 0.5)
    assert set(found) == set(counts) - {b"", *units}
    for w, (c, k) in found.items():
        gain = [sum(before[w, i] * (log(pairs[i, b]) - log(pairs[:, b].sum())) + after[w, i] * (log(pairs[b, i]) - log(pairs[b].sum())) for i in range(6)) for b in range(1, 6)]
        assert c == counts[w] and (k == first(w) if c < lm.LEAST else abs(gain[k - 1] - max(gain)) < 1e-6)
    model, table, _ = fitted(docs)
    moved = [w for w, (k, c) in table.items() if c >= lm.LEAST and k != model.group_class[lm.ending(w)]]
    assert len(moved) > 20


def test_probabilities_sum_to_one(docs, rows):
    model, table, of = fitted(docs)
    pairs, once = bigrams([toks(r[1]) for r in rows], of, model.classes), np.zeros(model.classes)
    for k, c in table.values():
        once[k] += c == 1
    transition, known, unknown = lm.probabilities(pairs, once)
    assert np.allclose((10**transition).sum(axis=1), 1)
    mass = np.zeros(model.classes)
    for w, c in Counter(w for r in rows for w in toks(r[1])).items():
        mass[of(w)] += c * 10 ** known[of(w)]
    assert np.allclose((mass + 10**unknown)[mass > 0], 1)


def test_no_rows_and_no_training(docs, no_docs, rows):
    assert lm.score(no_docs, F.lit(True)).collect() == []
    found = lm.score(docs, F.lit(False)).collect()
    assert len(found) == len(rows) and all(r.n_known == 0 and r.base_score == 0 and r.train_tokens == 0 and r.score < 0 for r in found)


def test_exchange_finds_alternating_classes():
    n = 21
    pairs = np.zeros((n, n), dtype=np.int64)
    rng = np.random.default_rng(1)
    pairs[1:11, 11:] = rng.poisson(5, (10, 10))
    pairs[11:, 1:11] = rng.poisson(5, (10, 10))
    label = lm.exchange(pairs, classes=3)
    assert len(set(label[1:11])) == 1 and len(set(label[11:])) == 1 and label[1] != label[11]


def likelihood(pairs, label, k):
    onehot = np.eye(k)[label]
    n = onehot.T @ pairs @ onehot
    return lm._f(n).sum() - lm._f(n.sum(0)).sum() - lm._f(n.sum(1)).sum()


def test_exchange_ends_in_a_local_optimum():
    pairs = np.random.default_rng(3).integers(0, 30, (16, 16))
    label = lm.exchange(pairs, classes=4, sweeps=100)
    best = likelihood(pairs, label, 4)
    for w in range(1, 16):
        for b in range(1, 4):
            other = label.copy()
            other[w] = b
            assert likelihood(pairs, other, 4) <= best + 1e-6
