"""Status of calculation folders as their logs arrive (an extension: the batch operators see a finite listing)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crystalspark.operators import calculations as calc


def arrivals(spark: SparkSession, root: str, pattern: str = "*.out") -> DataFrame:
    """A stream of log files under ``root``: path, time, text."""
    return (
        spark.readStream.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
        .schema("path string, modificationTime timestamp, length long, content binary").load(root)
        .select("path", "modificationTime", F.col("content").cast("string").alias("out"))
    )


def latest_status(stream: DataFrame, root: str, watermark: str = "1 day") -> DataFrame:
    """(system, latest): state of the newest log of each system; files seen again within the watermark count once."""
    seen = stream.withWatermark("modificationTime", watermark).dropDuplicatesWithinWatermark(["path", "modificationTime"])
    df = calc.classify(seen.withColumn("summary", F.lit(None).cast("string")).withColumn("has_xml", F.lit(False)))
    system = F.split(F.regexp_replace("path", "^.*" + root.strip("/") + "/", ""), "/")[0]
    return df.groupBy(system.alias("system")).agg(F.max_by("status", "modificationTime").alias("latest"))
