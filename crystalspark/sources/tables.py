"""Readers of parameter, Z-matrix and key-value files, in DataFrame operations where lines stand alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, line) of text files."""
    whole = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    return whole.select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", "\\r?\\n")).alias("line_no", "line"))


def potentials(numbered: DataFrame) -> DataFrame:
    """(path, section, site_a, site_b, key, values) of potential files: ``!`` starts a comment, START and END name sections."""
    clean = numbered.withColumn("line", F.trim(F.regexp_replace("line", "!.*$", ""))).where("line <> ''")
    mark = F.regexp_extract("line", r"(?i)^(?:START)\s+(\S+)", 1)
    w = W.partitionBy("path").orderBy("line_no")
    state = F.when(mark != "", mark).when(F.col("line").rlike("(?i)^END\\b"), F.lit(""))
    df = clean.withColumn("section", F.upper(F.coalesce(F.last(state, ignorenulls=True).over(w), F.lit("")))).where((mark == "") & ~F.col("line").rlike("(?i)^END\\b") & (F.col("section") != ""))
    parts = F.split("line", r"\s+")
    pair = F.col("section").startswith("PARAM") & (F.size(parts) >= 3)
    return df.select(
        "path", "section", F.when(pair, parts[0]).alias("site_a"), F.when(pair, parts[1]).alias("site_b"),
        F.when(~pair, F.trim(F.substring_index("line", ":", 1))).alias("key"),
        F.when(pair, F.transform(F.slice(parts, F.lit(3), F.greatest(F.size(parts) - 2, F.lit(0))), lambda x: x.try_cast("double"))).alias("values"),
        F.when(~pair & F.col("line").contains(":"), F.trim(F.regexp_extract("line", ":(.*)$", 1))).alias("value"),
    )


def zmatrices(numbered: DataFrame) -> DataFrame:
    """(mol_id, row_index, element, references and values) of numeric Z-matrix files; ``#`` starts a comment."""
    clean = numbered.withColumn("line", F.trim(F.regexp_replace("line", "#.*$", ""))).where("line <> ''")
    parts = F.split("line", r"\s+")
    n = F.row_number().over(W.partitionBy("path").orderBy("line_no"))
    part = lambda k, kind: F.get(parts, F.lit(k)).try_cast(kind)
    return clean.select(
        F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("mol_id"), n.cast("int").alias("row_index"), parts[0].alias("element"),
        part(1, "int").alias("bond_to"), part(2, "double").alias("bond_length"), part(3, "int").alias("angle_to"), part(4, "double").alias("angle_deg"), part(5, "int").alias("dihedral_to"), part(6, "double").alias("dihedral_deg"),
    )


def setting(pairs: DataFrame, tags: list[str]) -> DataFrame:
    """The first of the tags with a value in (tag, path) rows; an empty value at an earlier tag ends the search."""
    rank = F.array_position(F.array(*[F.lit(t) for t in tags]), F.col("tag"))
    return pairs.where(rank > 0).agg(F.nullif(F.min_by(F.trim(F.coalesce("path", F.lit(""))), rank), F.lit("")).alias("value"))


def first_present(*sources: DataFrame, on: str) -> DataFrame:
    """Rows of the first source that has a key, sources in order of priority."""
    tagged = [s.withColumn("_priority", F.lit(i)) for i, s in enumerate(sources)]
    df = tagged[0]
    for other in tagged[1:]:
        df = df.unionByName(other)
    return df.withColumn("_r", F.row_number().over(W.partitionBy(on).orderBy("_priority"))).where("_r = 1").drop("_r", "_priority")
