"""Periodic bonds, connected components and molecules of structures.

All joins are equi-joins on ``structure_id`` with a distance predicate on top,
so one shuffle by structure serves every step and no structure meets another.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from crystalspark.functions import geometry as g
from crystalspark.operators import bonded, dims
from crystalspark.operators.bonded import BOX


def pairs(atoms: DataFrame, columns: list[str]) -> DataFrame:
    """Every two atoms of a structure, i before j, with the columns of both (suffix 1 and 2) and the lattice once."""
    lattice = [c for c in g.LATTICE if c in atoms.columns]
    left = atoms.select("structure_id", *lattice, F.col("atom_idx").alias("i"), *[F.col(c).alias(f"{c}1") for c in columns])
    right = atoms.select("structure_id", F.col("atom_idx").alias("j"), *[F.col(c).alias(f"{c}2") for c in columns])
    return left.join(right, "structure_id").where("i < j")


def let(name: str, value: str, then: str) -> str:
    """SQL of ``then`` with ``name`` for a value that is worked out once, however often it is used."""
    return f"get(transform(array({value}), {name} -> {then}), 0)"


def along_axes(point: list[str], reach: str, then: str) -> Column:
    """``then``, SQL over a struct ``v`` with, for each axis c, the fractional place fc of a point, one over the height of the cell sc, and the reach in cells rc."""
    struct = lambda fields: "named_struct(" + ", ".join(f"'{k}', {x}" for k, x in fields.items()) + ")"
    given = struct({c: c for c in g.LATTICE} | dict(zip("xyz", point)) | {"reach": reach})
    cross = lambda p, q: {"x": f"l.{p}y * l.{q}z - l.{p}z * l.{q}y", "y": f"l.{p}z * l.{q}x - l.{p}x * l.{q}z", "z": f"l.{p}x * l.{q}y - l.{p}y * l.{q}x"}
    normals = {f"{n}{k}": x for n, pq in zip("uvw", ("bc", "ca", "ab")) for k, x in cross(*pq).items()}
    turned = struct(normals | {c: f"l.{c}" for c in ("ax", "ay", "az", "x", "y", "z", "reach")})
    volume = "(n.ax * n.ux + n.ay * n.uy + n.az * n.uz)"
    places = {f"f{c}": f"(n.x * n.{r}x + n.y * n.{r}y + n.z * n.{r}z) / {volume}" for c, r in zip("xyz", "uvw")}
    sizes = {f"s{c}": f"sqrt(n.{r}x * n.{r}x + n.{r}y * n.{r}y + n.{r}z * n.{r}z) / abs({volume})" for c, r in zip("xyz", "uvw")}
    placed = struct(places | sizes | {"reach": "n.reach"})
    reaches = struct({f"{k}{c}": f"p.{k}{c}" for k in "fs" for c in "xyz"} | {f"r{c}": f"p.reach * p.s{c} + 1e-9D" for c in "xyz"})
    return F.expr(let("l", given, let("n", turned, let("p", placed, let("v", reaches, then)))))


def boxes(reach: str | None = None) -> Column:
    """The box of a row's atom along each axis (x, y, z), or with ``reach`` (SQL) all boxes it touches there, as arrays; round the cell's edges.

    The cell is cut so that a box is at least BOX wide, or is the whole cell.
    """
    fields = []
    for c in "xyz":
        n, f = f"greatest(1, int(floor(1 / v.s{c} / {BOX}D)))", f"(v.f{c} - floor(v.f{c}))"
        if reach is None:
            found = f"least(int(floor({f} * {n})), {n} - 1)"
        else:
            low, high = (f"int(floor(({f} {way} v.r{c}) * {n}))" for way in "-+")
            found = f"transform(sequence({low}, least({high}, {low} + {n} - 1)), x -> pmod(x, {n}))"
        fields.append(f"'{c}', {found}")
    return along_axes(list("xyz"), reach or "0D", f"named_struct({', '.join(fields)})")


def neighbours(atoms: DataFrame, reach: str, columns: list[str], looks: str) -> DataFrame:
    """Every two atoms of a structure with an image within ``reach`` (SQL) of the one that ``looks`` for the other, and some more.

    Rows have the lattice and, as ``a`` and ``b``, structs of atom_idx (as k)
    and ``columns``; ``looks`` is a condition on them that holds for exactly one
    order of each pair. A structure's cell is cut into boxes: an atom is sent to
    those that its reach touches and meets there, by an equi-join, the atoms
    that lie in them, so the work grows with the atoms and not with their pairs.
    """
    own = F.struct(F.col("atom_idx").alias("k"), *columns)
    left = atoms.select("structure_id", *g.LATTICE, own.alias("a"), boxes(reach).alias("_t"))
    for c in "xyz":
        left = left.withColumn(f"_b{c}", F.explode_outer(f"_t.{c}"))  # never empty; the outer form lets no filter copy the expression
    right = atoms.select("structure_id", own.alias("b"), boxes().alias("_t")).select("structure_id", "b", *[F.coalesce(F.col(f"_t.{c}"), F.lit(0)).alias(f"_b{c}") for c in "xyz"])
    return left.drop("_t").join(right, ["structure_id", "_bx", "_by", "_bz"]).where(looks).drop("_bx", "_by", "_bz")


def contacts(atoms: DataFrame, scale: float = 1.2) -> DataFrame:
    """(structure_id, i, j, sx, sy, sz, distance, ratio): the shortest image of each pair that lies within the scaled radius sum.

    Coordinates may lie in any cell and cells may be thinner than a bond: the
    larger atom of a pair looks for the other in the boxes around it, and the
    images looked at follow from the lattice; the structures of a batch together.
    """
    return bonded.bond_rows(atoms, list("xyz"), lambda found: found.contacts(scale))


def single_hydrogen_bonds(bonds: DataFrame) -> DataFrame:
    """Each hydrogen keeps its shortest bond; hydrogens choose in index order, so an earlier choice removes bonds that a later one would see.

    Only structures in which a hydrogen has several bonds pass through Python.
    """
    ends = bonds.select("structure_id", F.explode(F.array(F.struct(F.col("i").alias("k"), F.col("element1").alias("e")), F.struct(F.col("j").alias("k"), F.col("element2").alias("e")))).alias("x"))
    several = ends.where("x.e = 'H'").groupBy("structure_id", "x.k").agg(F.count("*").alias("n")).where("n > 1").select("structure_id").distinct()

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        alive = {(r.i, r.j): (r.distance, r.ratio) for r in pdf.itertuples()}
        hydrogens = sorted({r.i for r in pdf.itertuples() if r.element1 == "H"} | {r.j for r in pdf.itertuples() if r.element2 == "H"})
        for h in hydrogens:
            mine = [k for k in alive if h in k]
            if len(mine) > 1:
                best = min(mine, key=lambda k: (*alive[k], k))
                for k in mine:
                    if k != best:
                        del alive[k]
        return pdf[[(r.i, r.j) in alive for r in pdf.itertuples()]]

    plain = bonds.join(several, "structure_id", "left_anti")
    chosen = bonds.join(several, "structure_id", "left_semi").groupBy("structure_id").applyInPandas(choose, bonds.schema)
    return plain.unionByName(chosen)


def pair_table_bonds(atoms: DataFrame) -> DataFrame:
    """(structure_id, i, j, distance) of pairs strictly within the cutoff of their elements, by the nearest image; atoms meet in boxes as for ``contacts``."""
    near = bonded.bond_rows(atoms, ["fx", "fy", "fz"], lambda found: found.within_cutoffs())
    return near.select("structure_id", "i", "j", "element1", "element2", "distance")


def components(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """(structure_id, atom_idx, component): the smallest index that bonds reach.

    One row a structure: its bonds fold over an array of labels, inside the JVM.
    """
    counts = atoms.groupBy("structure_id").agg(F.count("*").cast("int").alias("n"))
    edges = bonds.groupBy("structure_id").agg(F.sort_array(F.collect_list(F.struct("i", "j"))).alias("edges"))
    joined = counts.join(edges, "structure_id", "left").withColumn("edges", F.coalesce("edges", F.array().cast("array<struct<i:int,j:int>>")))

    def fold(acc, e):
        low, high = F.least(F.get(acc, e["i"]), F.get(acc, e["j"])), F.greatest(F.get(acc, e["i"]), F.get(acc, e["j"]))
        return F.transform(acc, lambda x: F.when(x == high, low).otherwise(x))

    labels = F.aggregate("edges", F.sequence(F.lit(0), F.col("n") - 1), fold)
    return joined.select("structure_id", F.posexplode(labels).alias("atom_idx", "component"))


def molecules(atoms: DataFrame, parts: DataFrame) -> DataFrame:
    """(structure_id, component, n_atoms, n_heavy, weight, formula) of every component."""
    mass = F.broadcast(dims.elements(atoms.sparkSession).select("element", "mass"))
    counted = atoms.select("structure_id", "atom_idx", "element").join(parts, ["structure_id", "atom_idx"]).join(mass, "element", "left")
    counted = counted.withColumn("mass", dims.known(counted, "mass"))
    each = counted.groupBy("structure_id", "component", "element").agg(F.count("*").alias("n"), F.sum("mass").alias("m"))
    return each.groupBy("structure_id", "component").agg(
        F.sum("n").alias("n_atoms"), F.sum(F.when(F.col("element") != "H", F.col("n")).otherwise(0)).alias("n_heavy"), F.sum("m").alias("weight"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("element", "n"))), lambda x: F.concat(x["element"], x["n"].cast("string"))), "").alias("formula"),
    )


WATER = "H2O1"


def is_water(formula) -> object:
    return formula == WATER


@lru_cache(16_384)
def signed(elements: tuple[str, ...], links: tuple[tuple[int, int], ...]) -> str:
    """``refined`` of a molecule; equal small ones are many."""
    return refined(elements, links)


def refined(elements: Sequence[str], links: Sequence[tuple[int, int]]) -> str:
    """A signature of a molecule: labels of its atoms and bonds, refined until they tell no more atoms apart.

    Labels start from element and degree and take in the sorted labels of the
    neighbours each round, so isomorphic molecules agree whatever their order.
    """
    around: list[list[int]] = [[] for _ in elements]
    for i, j in links:
        around[i].append(j)
        around[j].append(i)
    digest = lambda parts: md5("|".join(parts).encode()).hexdigest()
    labels = [f"{e}{len(n)}" for e, n in zip(elements, around)]
    kinds, rounds = 0, 0
    while len(set(labels)) > kinds:
        kinds, rounds = len(set(labels)), rounds + 1
        labels = [digest([own, *sorted(labels[k] for k in n)]) for own, n in zip(labels, around)]
    return digest([str(rounds), *sorted(labels), *sorted("-".join(sorted((labels[i], labels[j]))) for i, j in links)])


def signatures(atoms: DataFrame, bonds: DataFrame, parts: DataFrame) -> DataFrame:
    """(structure_id, component, signature): ``refined`` of every molecule."""
    members = atoms.select("structure_id", "atom_idx", "element").join(parts, ["structure_id", "atom_idx"])
    rows = members.groupBy("structure_id").agg(F.collect_list(F.struct("atom_idx", "element", "component")).alias("atoms"))
    links = bonds.groupBy("structure_id").agg(F.collect_list(F.struct("i", "j")).alias("links"))
    return signed_rows(rows.join(links, "structure_id", "left"))


def signed_rows(rows: DataFrame) -> DataFrame:
    """``signatures`` of structures as one row each, with ``atoms`` (atom_idx, element, component) and ``links`` (i, j); many to a batch."""

    def flat(lists: pa.Array, *names: str) -> tuple[list[int], list[list]]:
        """Offsets of a batch's lists and the fields of their structs, as lists of plain values."""
        offsets = lists.offsets.to_numpy()
        inner = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
        fields = dict(zip([f.name for f in inner.type], inner.flatten()))
        return (offsets - offsets[0]).tolist(), [fields[n].to_pylist() for n in names]

    def sign(batches):
        for batch in batches:
            rows, components, found = [], [], []
            starts, (index, elements, parts) = flat(batch.column("atoms"), "atom_idx", "element", "component")
            ends, (first, second) = flat(batch.column("links"), "i", "j")
            for row in range(len(batch)):
                place, molecules = {}, {}
                for p in range(starts[row], starts[row + 1]):
                    own, _ = molecules.setdefault(parts[p], ([], []))
                    place[index[p]] = parts[p], len(own)
                    own.append(elements[p])
                for e in range(ends[row], ends[row + 1]):
                    component, i = place[first[e]]
                    molecules[component][1].append((i, place[second[e]][1]))
                for component, (own, near) in molecules.items():
                    rows.append(row)
                    components.append(component)
                    found.append(signed(tuple(own), tuple(near)) if len(own) <= 64 else refined(own, near))
            yield pa.RecordBatch.from_arrays([batch.column("structure_id").take(pa.array(rows, pa.int64())), pa.array(components, pa.int32()), pa.array(found, pa.string())], names=["structure_id", "component", "signature"])

    return rows.select("structure_id", "atoms", "links").mapInArrow(sign, f"structure_id {dict(rows.dtypes)['structure_id']}, component int, signature string")


def unique_molecules(signed: DataFrame) -> DataFrame:
    """(structure_id, signature, representative, copies): the first molecule of each signature and how many there are."""
    return signed.groupBy("structure_id", "signature").agg(F.min("component").alias("representative"), F.count("*").alias("copies"))


def unwrap(atoms: DataFrame, bonds: DataFrame, parts: DataFrame) -> DataFrame:
    """(structure_id, atom_idx, component, x, y, z) with each molecule in one piece across cell edges."""
    lists = bonds.groupBy("structure_id").agg(F.collect_list(F.struct("i", "j", "sx", "sy", "sz")).alias("edges"))
    rows = atoms.join(parts, ["structure_id", "atom_idx"]).groupBy("structure_id", *g.LATTICE).agg(F.array_sort(F.collect_list(F.struct("atom_idx", "component", "x", "y", "z"))).alias("points"))

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                cell = np.array([getattr(r, c) for c in g.LATTICE]).reshape(3, 3)
                near: dict[int, list] = {}
                for e in r.edges if r.edges is not None else ():
                    s = np.array([e["sx"], e["sy"], e["sz"]])
                    near.setdefault(e["i"], []).append((e["j"], s))
                    near.setdefault(e["j"], []).append((e["i"], -s))
                shift: dict[int, np.ndarray] = {}
                for p in r.points:
                    if p["atom_idx"] in shift:
                        continue
                    shift[p["atom_idx"]], stack = np.zeros(3), [p["atom_idx"]]
                    while stack:
                        k = stack.pop()
                        for m, s in near.get(k, ()):
                            if m not in shift:
                                shift[m] = shift[k] + s
                                stack.append(m)
                for p in r.points:
                    x = np.array([p["x"], p["y"], p["z"]]) + shift[p["atom_idx"]] @ cell
                    out.append((r.structure_id, p["atom_idx"], p["component"], *x.tolist()))
            yield pd.DataFrame(out, columns=["structure_id", "atom_idx", "component", "x", "y", "z"])

    return rows.join(lists, "structure_id", "left").mapInPandas(run, f"structure_id {dict(rows.dtypes)['structure_id']}, atom_idx int, component int, x double, y double, z double")


def boxed(points: DataFrame, box: float = 20.0) -> DataFrame:
    """Molecules moved so that their centroid is the middle of a cubic box."""
    w = W.partitionBy("structure_id", "component")
    return points.withColumns({c: F.col(c) - F.avg(c).over(w) + box / 2 for c in "xyz"})
