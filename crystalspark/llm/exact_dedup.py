"""Exact duplicates by progressive refinement, in DataFrame operations only.

Documents are grouped by length; groups of two or more are split by a hash of
a short prefix; only groups that still hold two or more rows have their full
content read and hashed (SHA-256). Each level shuffles only its small keys,
with map-side counts, so a hot group costs one row a task. The survivors of a
level reach the next scan as a broadcast where their counted rows are few, and
by a shuffled semi-join beyond that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from crystalspark.llm.common import materialise

#: Survivor keys (a few bytes each) that may be broadcast.
BROADCAST_ROWS = 200_000


def content(text: str = "text"):
    return F.coalesce(F.col(text), F.lit(""))


def length_key(text: str = "text"):
    return F.octet_length(content(text)).cast("long")


def prefix_key(text: str = "text", prefix: int = 64):
    return F.xxhash64(F.substring(content(text), 1, prefix))


def full_key(text: str = "text"):
    return F.unhex(F.sha2(content(text).cast("binary"), 256))


def _small(keys: DataFrame) -> DataFrame:
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys


def duplicate_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", prefix: int = 64) -> DataFrame:
    """(_len, _prefix, _full, keep_id, group_size) of every group of two or more equal texts; null counts as empty."""
    rows = docs.select(F.col(doc_id).alias("_id"), content(text).alias("_text"), length_key(text).alias("_len"))
    lengths = materialise(rows.groupBy("_len").agg(F.count("*").alias("n")).where("n > 1").select("_len"), "dedup-lengths")
    left = rows.join(_small(lengths), "_len", "left_semi").withColumn("_prefix", prefix_key("_text", prefix))
    prefixes = materialise(left.groupBy("_len", "_prefix").agg(F.count("*").alias("n")).where("n > 1").select("_len", "_prefix"), "dedup-prefixes")
    left = left.join(_small(prefixes), ["_len", "_prefix"], "left_semi").withColumn("_full", full_key("_text"))
    return left.groupBy("_len", "_prefix", "_full").agg(F.max("_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1")


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", prefix: int = 64) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    The row with the largest doc_id of each group of equal texts stays (null
    ids count as smallest); of repeated rows with that id, one stays. Null text
    equals empty text. An empty table returns no rows. Other columns are
    dropped, so clashing names cannot meet.
    """
    groups = materialise(duplicate_groups(docs, doc_id, text, prefix), "dedup-groups")
    rows = docs.select(F.col(doc_id).alias("_id"), length_key(text).alias("_len"), prefix_key(text, prefix).alias("_prefix"), full_key(text).alias("_full"))
    size = F.coalesce("group_size", F.lit(1)).cast("long")
    joined = rows.join(_small(groups), ["_len", "_prefix", "_full"], "left").select(
        "_id", "_full", size.alias("group_size"), F.when(size > 1, F.col("keep_id")).otherwise(F.col("_id")).alias("keep_id")
    )
    again = F.row_number().over(W.partitionBy("_id", "_full").orderBy("keep_id"))
    return joined.select(
        F.col("_id").alias("doc_id"), "keep_id", "group_size",
        (F.col("_id").eqNullSafe(F.col("keep_id")) & (again == 1)).alias("kept"),
        F.lower(F.hex("_full")).alias("text_sha256"),
    )


ORACLE = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text) AS keep_id,
       count(*) OVER (PARTITION BY text) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY text)
         AND row_number() OVER (PARTITION BY text, doc_id) = 1 AS kept,
       sha256(text) AS text_sha256
FROM t
"""
