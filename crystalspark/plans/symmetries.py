"""Queries about symmetry in any basis: operations found in cells, space-group names, records."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from crystalspark.functions import geometry as g
from crystalspark.operators import cells, compare, corpus, groups, jobs, symmetry
from crystalspark.plans.catalog import _IMAGES, ELEMENTS_SQL, OPS_SQL, W_, _canonical_sql, ops, query

#: Each structure's basis is sheared by steps of its own, and its origin moved by eighths.
SHEAR = {"_m": "structure_id % 3 - 1", "_n": "structure_id % 5 - 2", "_k": "structure_id % 4 - 1", "_o": "structure_id % 8"}


def full_cells(spark, sf_dir) -> DataFrame:
    """Atoms of the full cells of the corpus."""
    return numbered(symmetry.expand(corpus.atoms(spark, sf_dir), ops(spark)))


def numbered(expanded: DataFrame) -> DataFrame:
    """Expanded sites as atoms of full cells."""
    sites = expanded.withColumnsRenamed({"op_idx": "_op", "atom_idx": "_atom", "fx": "_x", "fy": "_y", "fz": "_z"})
    number = F.row_number().over(W.partitionBy("structure_id").orderBy("_atom", "_op")) - 1
    return sites.select("structure_id", number.alias("atom_idx"), F.col("site_label").alias("label"), "element", F.col("gx").alias("fx"), F.col("gy").alias("fy"), F.col("gz").alias("fz"), "a", "b", "c", "alpha", "beta", "gamma")


def steps(df: DataFrame) -> DataFrame:
    return df.withColumns({k: F.expr(v) for k, v in SHEAR.items()})


def sheared(atoms: DataFrame) -> DataFrame:
    """The same crystals with b' = b + m a and c' = c + n a + k b, and the origin at (o, 0, o) eighths."""
    df = steps(corpus.with_lattice(atoms))
    va, vb, vc = (tuple(F.col(f"{v}{x}") for x in "xyz") for v in "abc")
    vb = tuple(y + F.col("_m") * x for x, y in zip(va, vb))
    vc = tuple(z + F.col("_n") * x + F.col("_k") * y for x, y, z in zip(va, (F.col(f"b{x}") for x in "xyz"), vc))
    zero = (F.lit(0.0),) * 3
    fz = F.col("fz") - F.col("_o") / 8
    fy = F.col("fy") - F.col("_k") * fz
    fx = F.col("fx") - F.col("_o") / 8 - F.col("_m") * fy - F.col("_n") * fz
    cell = {"a": g.norm(va), "b": g.norm(vb), "c": g.norm(vc), "alpha": g.angle(vb, zero, vc), "beta": g.angle(va, zero, vc), "gamma": g.angle(va, zero, vb)}
    return df.select("structure_id", "atom_idx", "label", "element", *[f.alias(n) for f, n in ((fx, "fx"), (fy, "fy"), (fz, "fz"))], *[v.alias(k) for k, v in cell.items()])


_LENGTH = "sqrt(greatest({0}x*{0}x*a*a + {0}y*{0}y*b*b + {0}z*{0}z*c*c + 2*{0}x*{0}z*a*c*cosb, 0))"
_DOT = "({0}x*{1}x*a*a + {0}y*{1}y*b*b + {0}z*{1}z*c*c + ({0}x*{1}z + {0}z*{1}x)*a*c*cosb)"


def _images_of(letter: str, length: str) -> str:
    """Lattice vectors of the length of a basis vector, by cell."""
    return f"{letter}_ AS (SELECT k.*, n.x AS {letter}x, n.y AS {letter}y, n.z AS {letter}z FROM kinds k JOIN steps n ON abs({_LENGTH.format('n.')} - {length}) <= 0.05)"


_OPERATIONS_SQL = f"""{W_}, {OPS_SQL}, {_IMAGES},
sites AS (SELECT structure_id, element, gx, gy, gz, any_value(a) AS a, any_value(b) AS b, any_value(c) AS c, any_value(beta) AS beta, min(atom_idx * 100 + op_idx) AS spot FROM im GROUP BY structure_id, element, gx, gy, gz),
kinds AS (SELECT DISTINCT a, b, c, beta, cos(radians(beta)) AS cosb FROM sites),
steps AS (SELECT x.range AS x, y.range AS y, z.range AS z FROM range(-3, 4) x, range(-3, 4) y, range(-3, 4) z),
{_images_of('p', 'a')}, {_images_of('q', 'b')}, {_images_of('s', 'c')},
rot AS (
  SELECT p.a, p.b, p.c, p.beta, cosb, px, py, pz, qx, qy, qz, sx, sy, sz
  FROM p_ p JOIN q_ q USING (a, b, c, beta, cosb) JOIN s_ s USING (a, b, c, beta, cosb)
  WHERE abs({_DOT.format('p', 'q')}) <= 0.05 * greatest(a, b, c) AND abs({_DOT.format('q', 's')}) <= 0.05 * greatest(a, b, c)
    AND abs({_DOT.format('p', 's')} - a*c*cosb) <= 0.05 * greatest(a, b, c)
    AND abs(px*(qy*sz - qz*sy) - py*(qx*sz - qz*sx) + pz*(qx*sy - qy*sx)) = 1
),
counts AS (SELECT structure_id, element, count(*) AS n FROM sites GROUP BY ALL),
rare AS (SELECT structure_id, arg_min(element, (n, element)) AS element FROM counts GROUP BY ALL),
rares AS (SELECT s.*, row_number() OVER (PARTITION BY structure_id ORDER BY spot) AS place FROM sites s JOIN rare USING (structure_id, element)),
turned AS (SELECT s.structure_id, s.element, s.spot, s.gx, s.gy, s.gz, r.*, gx*px + gy*qx + gz*sx AS ux, gx*py + gy*qy + gz*sy AS uy, gx*pz + gy*qz + gz*sz AS uz FROM sites s JOIN rot r USING (a, b, c, beta)),
origin AS (SELECT t.* FROM turned t JOIN rares USING (structure_id, spot) WHERE place = 1),
tried AS (
  SELECT o.structure_id, o.px, o.py, o.pz, o.qx, o.qy, o.qz, o.sx, o.sy, o.sz, j.place, j.gx - o.ux AS tx, j.gy - o.uy AS ty, j.gz - o.uz AS tz FROM origin o JOIN rares j USING (structure_id)
),
gap AS (
  SELECT structure_id, px, py, pz, qx, qy, qz, sx, sy, sz, place, t.spot, any_value(tx) AS tx, any_value(ty) AS ty, any_value(tz) AS tz, any_value(t.a) AS a, any_value(t.b) AS b, any_value(t.c) AS c, any_value(t.cosb) AS cosb,
    min((vx - round_even(vx, 0))**2 * t.a*t.a + (vy - round_even(vy, 0))**2 * t.b*t.b + (vz - round_even(vz, 0))**2 * t.c*t.c + 2*(vx - round_even(vx, 0))*(vz - round_even(vz, 0))*t.a*t.c*cosb) AS far
  FROM (
    SELECT tr.*, t.spot, t.a, t.b, t.c, t.cosb, t.ux + tx - s.gx AS vx, t.uy + ty - s.gy AS vy, t.uz + tz - s.gz AS vz
    FROM tried tr JOIN turned t USING (structure_id, px, py, pz, qx, qy, qz, sx, sy, sz) JOIN sites s ON s.structure_id = t.structure_id AND s.element = t.element
  ) t GROUP BY structure_id, px, py, pz, qx, qy, qz, sx, sy, sz, place, t.spot
),
good AS (
  SELECT structure_id, px, py, pz, qx, qy, qz, sx, sy, sz, place, any_value(tx) AS tx, any_value(ty) AS ty, any_value(tz) AS tz, any_value(a) AS a, any_value(b) AS b, any_value(c) AS c, any_value(cosb) AS cosb
  FROM gap GROUP BY structure_id, px, py, pz, qx, qy, qz, sx, sy, sz, place HAVING max(far) <= 0.05 * 0.05
),
near AS (
  SELECT x.structure_id, x.px, x.py, x.pz, x.qx, x.qy, x.qz, x.sx, x.sy, x.sz, x.place, x.a, x.b, x.c, x.cosb, x.tx - y.tx AS vx, x.ty - y.ty AS vy, x.tz - y.tz AS vz
  FROM good x JOIN good y USING (structure_id, px, py, pz, qx, qy, qz, sx, sy, sz) WHERE y.place < x.place
),
again AS (
  SELECT DISTINCT structure_id, px, py, pz, qx, qy, qz, sx, sy, sz, place FROM near
  WHERE (vx - round_even(vx, 0))**2 * a*a + (vy - round_even(vy, 0))**2 * b*b + (vz - round_even(vz, 0))**2 * c*c + 2*(vx - round_even(vx, 0))*(vz - round_even(vz, 0))*a*c*cosb <= 0.05 * 0.05
)
SELECT structure_id, count(*)::INT AS n_operations FROM good ANTI JOIN again USING (structure_id, px, py, pz, qx, qy, qz, sx, sy, sz, place) GROUP BY structure_id"""


@query(_OPERATIONS_SQL)
def operations_any_basis(spark, sf_dir):
    """Operations found in cells given in a sheared basis with another origin; the SQL counts them in the basis they came from."""
    return cells.reduce_cells(sheared(full_cells(spark, sf_dir))).groupBy("structure_id").agg(F.max("n_operations").alias("n_operations"))


@query()
def cells_named(spark, sf_dir):
    """Space groups of the same cells, from their atoms alone."""
    return cells.named_cells(sheared(full_cells(spark, sf_dir)))


#: Cells of molecular-crystal size: all order lines of a customer in one cell, under the operations of P 21/c.
LARGE_CELL = {"a": 14.0, "b": 15.0, "c": 16.0, "alpha": 90.0, "beta": 100.0, "gamma": 90.0}


def large_cells(spark, sf_dir, customers: str = "true") -> DataFrame:
    """Atoms of full cells of about 160 atoms: those of a customer's orders, numbered over all of them."""
    orders = corpus.table(spark, sf_dir, "orders").where(customers).select(F.col("o_orderkey").alias("structure_id"), "o_custkey")
    lines = corpus.atoms(spark, sf_dir).join(orders, "structure_id").withColumn("fx", (F.col("fx") + F.col("structure_id") % 83 / 83.0) % 1)
    number = F.row_number().over(W.partitionBy("o_custkey").orderBy("structure_id", "atom_idx")) - 1
    unit = lines.select(F.col("o_custkey").alias("structure_id"), number.alias("atom_idx"), "label", "element", "fx", "fy", "fz", F.lit(1).alias("sg"), *[F.lit(v).alias(k) for k, v in LARGE_CELL.items()])
    return numbered(symmetry.expand(unit, ops(spark)))


_LARGE = f"""{W_}, {OPS_SQL}, big AS (SELECT o_custkey AS structure_id, element, (fx + (structure_id % 83) / 83.0::DOUBLE) % 1 AS fx, fy, fz FROM atoms JOIN orders ON o_orderkey = structure_id),
bim AS (SELECT structure_id, element, """ + ", ".join(_canonical_sql(f"o.r{k}1 * a.fx + o.r{k}2 * a.fy + o.r{k}3 * a.fz + o.t{k} / 24.0::DOUBLE") + f" AS g{k}" for k in (1, 2, 3)) + """ FROM big a JOIN ops o ON o.sg = 1),
bs AS (SELECT DISTINCT structure_id, element, g1, g2, g3 FROM bim)
SELECT structure_id, count(*) AS full_atoms, count(*) AS rebuilt_atoms, true AS reduced, true AS same_sites, true AS same_fingerprint FROM bs GROUP BY structure_id"""


@query(_LARGE)
def round_trip_full_cells(spark, sf_dir):
    """Full cells of a hundred and more atoms, given in sheared bases, reduced, expanded again and compared by sites and fingerprints (k = 100)."""
    return compared(sheared(large_cells(spark, sf_dir)))


def compared(full: DataFrame) -> DataFrame:
    found = compare.round_trip(full)
    return found.select("structure_id", "full_atoms", "rebuilt_atoms", (F.col("n_unique") * 4 <= F.col("full_atoms")).alias("reduced"), (F.col("displacement_to_full") <= 0.05).alias("same_sites"), (F.col("distance_to_full") <= 0.1).alias("same_fingerprint"))


_JOBS = f"""{W_}, {ELEMENTS_SQL}, odd AS (SELECT structure_id, CASE WHEN fx = 0 THEN 'Qq' WHEN fx = 0.5 THEN 'O' ELSE element END AS element FROM atoms),
counts AS (SELECT structure_id, element, count(*) AS n FROM odd GROUP BY ALL),
each AS (SELECT structure_id, bool_or(element = 'Qq') AS unknown, bool_or(element = 'C') AS carbon, bool_or(element = 'H') AS hydrogen,
  string_agg(element || n, ' ' ORDER BY element <> 'C', element <> 'H', element) AS formula, sum(n * mass) AS weight FROM counts LEFT JOIN el USING (element) GROUP BY structure_id)
SELECT structure_id, CASE WHEN NOT unknown AND carbon AND hydrogen THEN formula END AS formula, CASE WHEN NOT unknown AND carbon AND hydrogen THEN round(weight, 3) END AS weight,
  CASE WHEN unknown THEN 'elements' WHEN NOT carbon OR NOT hydrogen THEN 'composition' END AS failed_step,
  CASE WHEN unknown THEN 'nothing is known of element Qq' WHEN NOT carbon THEN 'no carbon in the cell' WHEN NOT hydrogen THEN 'no hydrogen in the cell' END AS error FROM each"""


@query(_JOBS)
def cell_jobs(spark, sf_dir):
    """The check of cells over the corpus with some elements made unknown or exchanged: structures that fail have a row that says where and why."""
    odd = corpus.atoms(spark, sf_dir).withColumn("element", F.when(F.col("fx") == 0, "Qq").when(F.col("fx") == 0.5, "O").otherwise(F.col("element")))
    steps = [x for x in jobs.CELL_STEPS if x[0] != "symmetry"]
    done = jobs.run(odd.select("structure_id", "atom_idx", "element", "fx", "fy", "fz", *jobs.CELL), ["atom_idx"], steps, jobs.CELL_RESULTS)
    return done.select("structure_id", "formula", F.round("weight", 3).alias("weight"), "failed_step", "error")


_NAMES = "(VALUES (0, 2, 'P -1', 2, 1, 0), (1, 14, 'P 21/c', 81, 1, 1), (2, 19, 'P 21 21 21', 115, -1, 3), (3, 15, 'C 2/c', 90, 7, 1)) v(sg, number, symbol, hall, lattice, n_records)"


@query(f"{W_} SELECT DISTINCT structure_id, number, symbol, hall, lattice, n_records, number AS moved_number, symbol AS moved_symbol, true AS expands_back FROM atoms JOIN {_NAMES} USING (sg)")
def space_group_names(spark, sf_dir):
    """Names of each structure's operations as given, and of the same rewritten in its sheared basis and moved origin; records expand back to all of them."""
    kinds = steps(corpus.structures(spark, sf_dir))

    def moved(batches):
        for pdf in batches:
            out = []
            for sg, m, n, k, o in pdf.itertuples(index=False):
                p, shift = np.array([[1, 0, 0], [m, 1, 0], [n, k, 1]], dtype=int), (Fraction(int(o), 8), Fraction(0), Fraction(int(o), 8))
                out += [(sg, m, n, k, o, op, groups.rebased(op, p, shift)) for op in corpus.GROUPS[sg]]
            yield pd.DataFrame(out, columns=["sg", *SHEAR, "op", "rewritten"])

    rewritten = kinds.select("sg", *SHEAR).distinct().mapInPandas(moved, "sg int, _m bigint, _n bigint, _k bigint, _o bigint, op string, rewritten string")
    each = kinds.select("structure_id", "sg", *SHEAR).join(F.broadcast(rewritten), ["sg", *SHEAR])  # at most 4 x 3 x 5 x 4 x 8 combinations
    given = groups.with_names(each.select("structure_id", "op")).select("structure_id", "number", "symbol", "hall", "lattice", F.size("records").alias("n_records"), "records")
    other = groups.with_names(each.select("structure_id", F.col("rewritten").alias("op"))).select("structure_id", F.col("number").alias("moved_number"), F.col("symbol").alias("moved_symbol"))
    listed = each.groupBy("structure_id").agg(F.array_sort(F.collect_set("op")).alias("ops"))
    whole = given.join(listed, "structure_id").join(other, "structure_id")
    return groups.expanding_back(whole).drop("ops", "records")


__all__ = ["cell_jobs", "cells_named", "operations_any_basis", "round_trip_full_cells", "space_group_names"]
