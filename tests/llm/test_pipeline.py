import pytest
from pyspark.sql import functions as F

from crystalspark.llm import mixing, registry
from crystalspark.llm import pipeline as cp
from tests.llm.conftest import SCHEMA, make_rows
from tests.llm.test_decontaminate import brute as brute_hits
from tests.llm.test_near_copies import brute as brute_groups


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, path = make_rows(seed=11), str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, rows[10][1]), (2, "zz yy")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(i, i % 2, int(i % 9 == 0)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def key(r):
    return str(r.doc_id), str(r.text)


def test_stages_match_brute_force(spark, folder):
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    for name, stage in cp.STAGES[:-1]:
        before = docs.collect()
        docs = cp.materialise(stage(spark, docs, folder), f"test-{name}")
        after = docs.collect()
        assert docs.columns == names
        if name == "toxicity":
            model = registry.toxicity_classifier(spark, folder, spark.createDataFrame(before, SCHEMA))
            kept = [r for r in registry.toxicity.score(spark.createDataFrame(before, SCHEMA), model, name="s").collect() if r.s < registry.TOXIC]
        elif name == "near_duplicates":
            groups = {}
            for r, g in zip(before, brute_groups([r.text for r in before])):
                groups.setdefault(g, []).append(r)
            least = lambda g: min((r.doc_id is None, r.doc_id or 0) for r in g)
            assert sorted(map(least, groups.values())) == sorted((r.doc_id is None, r.doc_id or 0) for r in after)
            member = {key(r): g for g, rows in groups.items() for r in rows}
            assert len({member[key(r)] for r in after}) == len(groups) == len(after)
            continue
        elif name == "decontamination":
            kept = [r for r in before if not brute_hits(r.text, items)[1]]
        else:
            chosen = mixing.mix(mixing.with_domain(spark.createDataFrame(before, SCHEMA)), cp.MIX_FRACTION, cp.MIX_EPOCHS)
            assert 0 < len(after) < len(before) and len(after) == chosen.count()
            assert sorted(str(r.doc_id) for r in chosen.collect()) == sorted(str(r.doc_id) for r in after)
            continue
        assert sorted(map(key, kept)) == sorted(map(key, after))
    last = cp.STAGES[-1][1](spark, docs, folder).collect()
    assert len(last) == docs.count()
    assert cp.run(spark, folder).count() == len(last)


def test_clashing_names(spark, folder):
    plain = spark.read.parquet(f"{folder}/documents.parquet")
    extra = ["_score", "score", "_raw", "raw", "_row", "row", "_row_number", "root", "items", "n_hit", "n_words", "spans", "none", "_whole", "_n", "_id", "_least", "domain", "tokens", "epoch", "start", "taken", "supply", "alloc", "limit", "_key", "_range", "fp", "size", "shard", "slot", "curve", "_text"]
    docs = plain.select("*", *[F.lit(f"v {c}").alias(c) for c in extra])
    for name, stage in cp.STAGES:
        found = stage(spark, docs, folder)
        if name == "sharding":
            assert found.count() == plain.count()
            continue
        assert found.columns == docs.columns, name
        rows = found.collect()
        assert rows and all(r[c] == f"v {c}" for r in rows for c in extra), name
        if name != "mixing":  # whose leaves follow the column domain
            assert sorted(map(key, rows)) == sorted(map(key, stage(spark, plain, folder).collect())), name


def test_no_documents(spark, tmp_path):
    path = str(tmp_path)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    assert cp.run(spark, path).count() == 0
