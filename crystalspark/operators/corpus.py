"""A deterministic crystal corpus drawn from the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from crystalspark.functions import geometry as g

#: Operations of P -1, P 21/c, P 21 21 21 and C 2/c (fixed values).
GROUPS = {
    0: ["x,y,z", "-x,-y,-z"],
    1: ["x,y,z", "-x,1/2+y,1/2-z", "-x,-y,-z", "x,1/2-y,1/2+z"],
    2: ["x,y,z", "1/2-x,-y,1/2+z", "-x,1/2+y,1/2-z", "1/2+x,1/2-y,-z"],
    3: ["x,y,z", "-x,y,1/2-z", "-x,-y,-z", "x,-y,1/2+z", "1/2+x,1/2+y,z", "1/2-x,1/2+y,1/2-z", "1/2-x,1/2-y,-z", "1/2+x,1/2-y,1/2+z"],
}
SYMBOLS = {0: "P -1", 1: "P 21/c", 2: "P 21 21 21", 3: "C 2/c"}
SYMBOL_ELEMENTS = ["C", "H", "N", "O", "S", "F", "Cl"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(structure_id, atom_idx, label, element, fx, fy, fz, sg, cell) of every order line; lines of an order are ordered by all their parts."""
    parts = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]
    order = W.partitionBy("l_orderkey").orderBy(*parts)
    # numbered before anything is named or derived: only given columns are shuffled, once for all that is drawn from them, and what follows stays dealt by structure
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", *parts).withColumn("_n", F.row_number().over(order))
    element = F.element_at(F.array(*[F.lit(e) for e in SYMBOL_ELEMENTS]), F.col("l_linenumber"))
    key = F.col("l_orderkey")
    out = li.select(
        key.alias("structure_id"), (F.col("_n") - 1).cast("int").alias("atom_idx"), element.alias("element"),
        (F.col("l_quantity") % 50 / 50.0).alias("fx"), (F.col("l_partkey") % 997 / 997.0).alias("fy"), (F.floor("l_extendedprice") % 1009 / 1009.0).alias("fz"),
        (key % 4).cast("int").alias("sg"), (5.0 + key % 7).alias("a"), (6.0 + key % 5).alias("b"), (7.0 + key % 3).alias("c"),
        F.lit(90.0).alias("alpha"), (90.0 + key % 20).alias("beta"), F.lit(90.0).alias("gamma"),
    )
    return out.withColumn("label", F.concat("element", (F.col("atom_idx") % 3).cast("string")))


def structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("structure_id")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("structure_id")).distinct().select(
        "structure_id", (key % 4).cast("int").alias("sg"), (5.0 + key % 7).alias("a"), (6.0 + key % 5).alias("b"), (7.0 + key % 3).alias("c"),
        F.lit(90.0).alias("alpha"), (90.0 + key % 20).alias("beta"), F.lit(90.0).alias("gamma"),
    )


def with_lattice(df: DataFrame) -> DataFrame:
    cell = [F.col(c) for c in ("a", "b", "c", "alpha", "beta", "gamma")]
    return df.withColumns(dict(zip(g.LATTICE, g.lattice(*cell))))


def with_cartesian(df: DataFrame) -> DataFrame:
    x = g.to_cartesian((F.col("fx"), F.col("fy"), F.col("fz")))
    return df.withColumns(dict(zip(("x", "y", "z"), x)))


#: The same corpus as SQL common table expressions.
SQL = """
atoms AS (
  SELECT l_orderkey AS structure_id,
    CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) - 1 AS INT) AS atom_idx,
    (['C','H','N','O','S','F','Cl'])[l_linenumber] AS element,
    (l_quantity % 50) / 50.0::DOUBLE AS fx, (l_partkey % 997) / 997.0::DOUBLE AS fy, (CAST(floor(l_extendedprice) AS BIGINT) % 1009) / 1009.0::DOUBLE AS fz,
    CAST(l_orderkey % 4 AS INT) AS sg, 5.0::DOUBLE + l_orderkey % 7 AS a, 6.0::DOUBLE + l_orderkey % 5 AS b, 7.0::DOUBLE + l_orderkey % 3 AS c,
    90.0::DOUBLE AS alpha, 90.0::DOUBLE + l_orderkey % 20 AS beta, 90.0::DOUBLE AS gamma
  FROM lineitem),
lat AS (SELECT *, element || CAST(atom_idx % 3 AS VARCHAR) AS label, a AS ax, 0.0::DOUBLE AS ay, 0.0::DOUBLE AS az,
    b * cos(radians(gamma)) AS bx, b * sin(radians(gamma)) AS "by", 0.0::DOUBLE AS bz, c * cos(radians(beta)) AS cx,
    c * (cos(radians(alpha)) - cos(radians(beta)) * cos(radians(gamma))) / sin(radians(gamma)) AS cy FROM atoms),
cells AS (SELECT *, sqrt(greatest(c * c - cx * cx - cy * cy, 0)) AS cz FROM lat),
cart AS (SELECT *, fx * ax + fy * bx + fz * cx AS x, fx * ay + fy * "by" + fz * cy AS y, fx * az + fy * bz + fz * cz AS z FROM cells)
"""
