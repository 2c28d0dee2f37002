import random

from crystalspark.llm import pipeline as cp
from crystalspark.llm import mixing
from crystalspark.llm import near_copies as nc
from tests.llm.conftest import SCHEMA


def sets_of(text):
    w = (text or "").lower().encode().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(texts):
    """Partition of the places of ``texts`` by links of Jaccard 0.8 or more."""
    sets, label = [sets_of(t) for t in texts], list(range(len(texts)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or a and b and 5 * len(a & b) >= 4 * len(a | b):
                x, y = find(i), find(j)
                label[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))]


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.random()}"
    return words


def make_texts():
    """Copies at every similarity around the bound, a dense group, chains, a shared passage, and texts without words."""
    rng = random.Random(2)
    word = lambda: f"w{rng.randrange(5000)}"
    passage, texts = [word() for _ in range(30)], [None, "", " \n", "one", "ONE", "one two"]
    for k in range(40):
        base = [word() for _ in range(rng.randint(5, 400))] + (passage if k % 2 else [])
        texts += [" ".join(base)] + [" ".join(edited(rng, base, rng.randint(0, 1 + len(base) // 40))) for _ in range(4)]
    dense = [word() for _ in range(150)]
    texts += [" ".join(edited(rng, dense, rng.randint(0, 3))) for _ in range(60)]
    chain = [word() for _ in range(200)]
    for _ in range(12):
        chain = chain[8:] + [word() for _ in range(8)]
        texts.append(" ".join(chain))
    return texts


def test_groups_match_brute_force(spark):
    texts = make_texts()
    want = brute(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "i long, text string").repartition(5)
    got = {r.row: r.root for r in nc.groups(docs, "i").collect()}
    assert len(got) == len(texts)
    assert len(set(zip(want, (got[i] for i in range(len(texts)))))) == len(set(want)) == len(set(got.values()))


def test_stage_keeps_one_row_of_each_group(spark, tmp_path):
    texts = make_texts()
    rows = [(i, t, "en", "src0", 0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = [r.doc_id for r in cp.drop_near_duplicates(spark, docs, str(tmp_path)).collect()]
    assert sorted(found) == sorted(set(brute(texts)))


def test_rows_without_an_id_of_their_own(spark, tmp_path):
    rng = random.Random(4)
    text = lambda: " ".join(f"w{rng.randrange(5000)}" for _ in range(40))
    rows = [(None if i % 3 else 7, text(), "en", "src0", 0) for i in range(30)]
    docs = spark.createDataFrame(rows + rows[:9], SCHEMA).repartition(3)
    kept = cp.drop_near_duplicates(spark, docs, str(tmp_path)).collect()
    assert sorted(r.text for r in kept) == sorted(r[1] for r in rows)
    mixed = cp.mix_sources(spark, docs, str(tmp_path)).collect()
    want = mixing.mix(mixing.with_domain(docs), cp.MIX_FRACTION, cp.MIX_EPOCHS).count()
    assert len(mixed) == want < docs.count()
