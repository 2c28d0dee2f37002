"""Shared helpers: the cluster's shared folder, written tables, hidden names.

Operators that need an intermediate more than once write it as Parquet under
``spark.checkpoint.dir``: every executor sees that folder, the commit protocol
makes a retried task harmless, and the lineage behind the table is cut.
"""

from __future__ import annotations

import uuid

import pyspark.cloudpickle as cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

import crystalspark

# Workers get this package's functions with the tasks and need no copy of it.
cloudpickle.register_pickle_by_value(crystalspark)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:  # only where no cluster names one, as in tests
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back."""
    spark, path = df.sparkSession, new_path(df.sparkSession, label)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(StructType(df.schema.fields)).parquet(path)


def worker_state() -> dict:
    """A dictionary that lives as long as the Python worker, over all tasks it runs."""
    import sys
    import types

    return vars(sys.modules.setdefault("_crystalspark_worker", types.ModuleType("_crystalspark_worker")))


def delete(spark: SparkSession, path: str) -> None:
    """Remove a written table through Hadoop's file system API."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def free_name(columns: list[str], wanted: str) -> str:
    """``wanted``, with underscores added until no column has that name."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw(column: str | Column) -> Column:
    """A text column as UTF-8 bytes; null becomes empty."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c.cast("binary"), F.lit(b"").cast("binary"))


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of the id written as text (null: empty text), modulo ``modulus``."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def running_start(df: DataFrame, order: list[str], amount: str, start: str, label: str) -> DataFrame:
    """Add the exclusive prefix sum of ``amount`` in the order of ``order``.

    Two levels: rows are dealt out by range and each range is summed on its
    own; only one row a range meets in the second, tiny, window. The ranged
    table is written once so that both levels see the same ranges.
    """
    from pyspark.sql import Window as W

    ranged = df.repartitionByRange(*[F.col(c) for c in order]).withColumn("_part", F.spark_partition_id())
    ranged = materialise(ranged.sortWithinPartitions(*order), label)
    totals = ranged.groupBy("_part").agg(F.sum(amount).alias("_total"))
    before = totals.select(
        "_part", F.coalesce(F.sum("_total").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before")
    )
    inner = W.partitionBy("_part").orderBy(*order)
    local = F.coalesce(F.sum(amount).over(inner.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return (
        ranged.withColumn("_local", local).join(F.broadcast(before), "_part").withColumn(start, (F.col("_before") + F.col("_local")).cast("long"))
        .drop("_part", "_local", "_before")
    )
