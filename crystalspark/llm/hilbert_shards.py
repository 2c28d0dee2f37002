"""Sharding along a Hilbert curve over several metadata dimensions.

Each dimension is quantised to ``2**bits`` cells by approximate quantiles
(numbers as they are; strings by the rows before them in order), the cells of
a row become its index on the Hilbert curve, rows are sorted by that index and
the order is cut into runs of equal row counts (law ``rows``: at most one
apart) or of near equal bytes (law ``bytes``). Rows near on the curve agree in
all dimensions, so the ranges in each shard's manifest prune files for
predicates on any of them.

Equal texts form a group that lies together in the order: all take the curve
index of the group's smallest row. Only where a cut falls inside a group does
it span two shards, as the law demands.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from crystalspark.llm.common import materialise, running_start

#: Name of each default dimension and how it is read from the row.
DIMENSIONS = {"source": "source", "lang": "lang", "size": "size"}


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert curve positions of integer points (rows) with ``bits`` bits a coordinate (Skilling, 2004)."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    index = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            index = (index << 1) | ((x[i] >> b) & 1)
    return index


def size_of(text: str = "text") -> Column:
    """UTF-8 bytes of the text (null: none) plus 16."""
    return (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 16).cast("long")


def as_numbers(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add each column as an order-preserving number under its new name; null is -1.

    Numbers stay as they are. A string becomes the rows whose string sorts
    before it: its distinct values are counted, summed up in order, and joined.
    """
    kinds = dict(df.dtypes)
    for name, column in columns.items():
        if kinds[column] == "string":
            counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("_rows"))
            ranks = materialise(running_start(counts, [column], "_rows", name, "hilbert-values").select(column, name), "hilbert-ranks")
            df = df.join(ranks, column, "left")
        else:
            df = df.withColumn(name, F.col(column).cast("double"))
    return df.withColumns({name: F.coalesce(F.col(name).cast("double"), F.lit(-1.0)) for name in columns})


def curve(df: DataFrame, dimensions: dict[str, str], bits: int) -> DataFrame:
    """Add ``_curve``. ``df`` is read several times and should be written; the quantiles that reach the driver number ``2**bits`` a dimension."""
    numbers = {f"_n_{k}": c for k, c in dimensions.items()}
    df = as_numbers(df, numbers)
    marks = [i / (1 << bits) for i in range(1, 1 << bits)]
    found = df.agg(*[F.percentile_approx(n, marks, 10_000).alias(n) for n in numbers]).first()
    cuts = [np.unique(np.array(found[n] or [], dtype=float)) for n in numbers]

    @F.pandas_udf("long")
    def index(*columns: pd.Series) -> pd.Series:
        cells = np.stack([np.searchsorted(cut, c.to_numpy(dtype=float), side="right") for cut, c in zip(cuts, columns)], axis=1)
        return pd.Series(hilbert_index(np.minimum(cells, (1 << bits) - 1), bits))

    return df.withColumn("_curve", index(*numbers)).drop(*numbers)


def assign(docs: DataFrame, shards: int = 40, law: str = "rows", dimensions: dict[str, str] | None = None, bits: int = 6, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Metadata of every row with size, text_crc32, curve index, shard and slot.

    Null text counts as empty, null dimensions sort first, missing dimensions
    are left out. Equal rows are told apart by their place in the order, so
    repeated rows each take a slot. An empty table returns no rows. Fewer rows
    than shards leave shards empty. Other columns are dropped.
    """
    if law not in ("rows", "bytes"):
        raise ValueError("law is rows or bytes")
    have = set(docs.columns) | {"size"}
    dimensions = {k: c for k, c in (dimensions or DIMENSIONS).items() if c in have}
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    keep = sorted({c for c in dimensions.values() if c not in (doc_id, "size")})
    meta = materialise(docs.select(F.col(doc_id).alias("doc_id"), *keep, size_of(text).alias("size"), F.crc32(body).alias("text_crc32"), F.xxhash64(body).alias("_text")), "hilbert-rows")
    meta = curve(meta, {k: "doc_id" if c == doc_id else c for k, c in dimensions.items()}, bits)
    meta = materialise(meta, "hilbert-meta")
    home = meta.groupBy("text_crc32", "_text", "size").agg(F.count("*").alias("_n"), F.min(F.struct("doc_id", "_curve"))["_curve"].alias("_home")).where("_n > 1")
    home = materialise(home, "hilbert-home")  # written, so that Spark can split a large group in the join
    placed = meta.join(home, ["text_crc32", "_text", "size"], "left").withColumn("curve", F.coalesce("_home", "_curve")).drop("_home", "_curve", "_n")
    order = ["curve", "_text", "text_crc32", "doc_id"]
    amount = F.lit(1).cast("long") if law == "rows" else F.col("size")
    placed = running_start(placed.withColumn("_amount", amount), order, "_amount", "_start", "hilbert-order")
    total = placed.agg(F.sum("_amount").alias("_total"))
    # total is one row
    placed = placed.crossJoin(F.broadcast(total)).withColumn("shard", F.expr(f"cast(least({shards - 1}, (cast(_start as decimal(38,0)) * {shards}) div _total) as int)"))
    if law == "bytes":
        placed = placed.drop("_start")
        rank = F.row_number().over(W.partitionBy("shard").orderBy(*order)) - 1
        return placed.withColumn("slot", rank.cast("long")).drop("_amount", "_total", "_text")
    ceiling = F.expr(f"(cast(shard as bigint) * _total + {shards - 1}) div {shards}")
    return placed.withColumn("slot", (F.col("_start") - ceiling).cast("long")).drop("_amount", "_total", "_start", "_text")


def manifest(assigned: DataFrame, dimensions: list[str]) -> DataFrame:
    """Rows, bytes and the range of each dimension per shard: what a reader prunes by."""
    ranges = [f(c).alias(f"{n}_{c}") for c in dimensions for n, f in (("min", F.min), ("max", F.max))]
    return assigned.groupBy("shard").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"), *ranges)


def prune(manifest_table: DataFrame, dimension: str, low, high) -> DataFrame:
    """Shards whose range of ``dimension`` meets [low, high]."""
    return manifest_table.where((F.col(f"max_{dimension}") >= F.lit(low)) & (F.col(f"min_{dimension}") <= F.lit(high))).select("shard")


def write_shards(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """Write ``docs`` in folders shard=N, each sorted by slot, and return the manifest, written beside them.

    Rows meet their places by id, text hash and, for repeated rows, their copy
    number. Columns named shard or slot are replaced. An empty table writes an
    empty manifest.
    """
    placed = materialise(assign(docs, text=text, doc_id=doc_id, **options), "hilbert-assigned")
    names = [c for c in docs.columns if c not in ("shard", "slot")]
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    key = F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))
    left = docs.select(*names, F.concat_ws(":", key, F.crc32(body).cast("string")).alias("_key"))
    left = left.withColumn("_copy", F.row_number().over(W.partitionBy("_key").orderBy(F.lit(0))))
    at = placed.select(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("text_crc32").cast("string")).alias("_key"), "shard", "slot")
    at = at.withColumn("_copy", F.row_number().over(W.partitionBy("_key").orderBy("slot")))
    joined = left.join(at, ["_key", "_copy"]).select(*names, "shard", "slot")
    joined.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").mode("overwrite").parquet(f"{path}/data")
    found = manifest(placed, [c for c in placed.columns if c not in ("shard", "slot", "text_crc32")])
    found.write.mode("overwrite").parquet(f"{path}/manifest")
    return docs.sparkSession.read.parquet(f"{path}/manifest")
