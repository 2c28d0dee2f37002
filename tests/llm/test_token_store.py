import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from crystalspark.llm import token_store as ts
from crystalspark.llm.common import new_path
from crystalspark.llm.registry import tokenizer_path


def expected(rows):
    tok = Tokenizer.from_file(tokenizer_path())
    out = []
    for r in rows:
        out.append((r[0], tok.encode(r[1] or "", add_special_tokens=False).ids + [1]))
    return out


def check(found, rows):
    want = expected(rows)
    assert len(found) == len(want)
    key = lambda i: -1 if i is None else i
    assert sorted((key(i), len(x), zlib.crc32(np.array(x, dtype="<u4").tobytes())) for i, x in want) == sorted((key(r.doc_id), r.n_tokens, r.ids_crc32) for r in found)
    at = 0
    for r in sorted(found, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    ids = [key(r.doc_id) for r in sorted(found, key=lambda r: r.start)]
    assert ids == sorted(ids)


def test_round_trip(spark, docs, clashing, rows):
    check(ts.store_and_sum(docs, tokenizer_path()).collect(), rows)
    check(ts.store_and_sum(clashing, tokenizer_path()).collect(), rows)


def test_empty_table(spark, no_docs):
    assert ts.store_and_sum(no_docs, tokenizer_path()).collect() == []


def test_rebuilt_ids_and_single_storage(spark, docs, rows):
    path = new_path(spark, "test-store")
    ts.write_store(docs, path, tokenizer_path(), wide=True)
    found = ts.read_documents(spark, path).collect()
    key = lambda x: (-1 if x[0] is None else x[0], x[1])
    assert sorted(((r.doc_id, r.ids) for r in found), key=key) == sorted(expected(rows), key=key)
    chunks = spark.read.parquet(path + "/chunks")
    assert chunks.count() == chunks.select("address").distinct().count()


def test_damage_is_noticed(spark, docs):
    path = new_path(spark, "test-store")
    ts.write_store(docs, path, tokenizer_path())
    chunks = spark.read.parquet(path + "/chunks").withColumn("ids", F.concat(F.lit(b"\x05\x00"), F.expr("substring(ids, 3)")))
    broken = new_path(spark, "test-store")
    for t in ("recipes", "manifest"):
        spark.read.parquet(f"{path}/{t}").write.parquet(f"{broken}/{t}")
    chunks.write.parquet(f"{broken}/chunks")
    with pytest.raises(Exception, match="does not match"):
        ts.read_sums(spark, broken).collect()
    bad = spark.read.parquet(f"{path}/recipes").withColumn("n_tokens", F.col("n_tokens") + 1)
    other = new_path(spark, "test-store")
    bad.write.parquet(f"{other}/recipes")
    spark.read.parquet(f"{path}/manifest").write.parquet(f"{other}/manifest")
    with pytest.raises(ValueError, match="manifest"):
        ts.verify_manifest(spark, other)


def cuts(ids):
    return ts.cut_points(len(ids), ts.cut_marks(np.asarray(ids)))


def test_cut_points_follow_content():
    rng = np.random.default_rng(1)
    body = rng.integers(0, 49000, 20000)
    a, b = np.concatenate([rng.integers(0, 49000, 777), body]), np.concatenate([rng.integers(0, 49000, 50), body])
    ends = [set((len(x) - np.array(cuts(x))).tolist()) for x in (a, b)]
    assert len(ends[0] & ends[1]) > 20
    assert cuts(np.arange(0)) == [] and cuts(np.arange(5)) == [5]
    sizes = np.diff([0, *cuts(np.zeros(30000, dtype=np.int64))])
    assert sizes.sum() == 30000 and sizes.max() <= ts.MOST + ts.LEAST
    both = np.concatenate([a, b])
    marks = ts.cut_marks(both)
    assert ts.cut_points(len(b), marks[marks > len(a)] - len(a)) == cuts(b)


def test_joined_sums():
    parts = [b"hello" * 31, b"world!" * 17, b"x", b"", b"tail" * 999]
    crcs, sizes = np.array([zlib.crc32(p) for p in parts]), np.array([len(p) for p in parts])
    assert ts.crc_join(crcs, sizes, np.array([0, 2])).tolist() == [zlib.crc32(parts[0] + parts[1]), zlib.crc32(b"".join(parts[2:]))]


def test_pieces_are_what_the_library_gives():
    tok = Tokenizer.from_file(tokenizer_path())
    encoder = ts.Encoder(tokenizer_path(), 1, "<u4")
    assert encoder.state["plain"]
    odd = ["Ünï ½ x²y ª don't we'll DON'T I'Ve", "日本語 text Σίσυφος ΣΑΣ", "é combining", "tab\x0bvt\x0cff\x1cfs", "nb\xa0sp\x85nel", "<|endoftext|> <|StartOfText|>", "", "   ", "İstanbul ÀÉ 's'tx're", "µ ß ÿ Ÿ œ", "­soft a­b", "a" * 9000, "!?" * 300, "\r\n x\r\n"]
    rng = np.random.default_rng(4)
    odd += ["".join(map(chr, rng.integers(9, 256, 60))) for _ in range(300)] + ["".join(map(chr, rng.integers(32, 700, 60))) for _ in range(100)]
    for text, ids in zip(odd, encoder.encode(odd)):
        assert np.frombuffer(ids, dtype="<u4").tolist() == tok.encode(text, add_special_tokens=False).ids + [1], text
