"""Reports over whole corpora: molecules of interest, Z-matrix quality, round trips, plotted points."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from crystalspark.functions import geometry as g
from crystalspark.operators import batches, bonded, dims, zmatrix
from crystalspark.operators import bonds as b
from crystalspark.operators.store import written


def chosen_molecules(molecules: DataFrame, signed: DataFrame) -> DataFrame:
    """The molecule of interest of each structure: (structure_id, component, n_atoms, formula, copies).

    Of the unique molecules that hold carbon and are not water the one with
    most atoms, then carbons, then copies, then the first; if none holds
    carbon, of all that are not water. A structure of water alone has no row.
    """
    groups = b.unique_molecules(signed).withColumnRenamed("representative", "component")
    df = molecules.join(groups, ["structure_id", "component"]).where(~b.is_water(F.col("formula")))
    carbons = F.coalesce(F.nullif(F.regexp_extract("formula", r"C(\d+)", 1), F.lit("")).try_cast("int"), F.lit(0))
    order = W.partitionBy("structure_id").orderBy((carbons > 0).desc(), F.desc("n_atoms"), carbons.desc(), F.desc("copies"), "component")
    return df.withColumn("_r", F.row_number().over(order)).where("_r = 1").select("structure_id", "component", "n_atoms", "formula", "copies")


def branch_report(atoms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Z-matrix rows of each structure's molecule of interest, and a report row a structure.

    ``atoms`` are full cells with lattice and Cartesian columns. The report
    counts rows by kind of dihedral, warnings and rows with errors.
    """
    molecules = bonded.structures(atoms, "atoms", "links", "molecules", unwrapped=True, single_hydrogen=True)
    done = written(of_interest(molecules), "branches")
    rows = done.select("structure_id", F.inline("rows")).drop("kind")
    count = lambda test: F.size(F.filter("rows", test)).cast("long")
    of_kind = lambda k: lambda r: r["kind"] == k
    most = F.array_max(F.transform("rows", lambda r: F.size(r["warnings"])))
    report = done.select(
        "structure_id", "component", "n_atoms", "formula", "copies", F.size("rows").cast("long").alias("entry_count"), most.alias("warning_count"),
        count(lambda r: F.size(zmatrix.faults(lambda c: r[c])) > 0).alias("validation_error_count"),
        *[count(of_kind(k)).alias(f"{k}_count") for k in ("proper", "improper", "fallback", "ambiguous")],
    )
    return rows, report


def chosen(molecules: list[dict], atoms: dict[int, list[dict]], links: list[dict]) -> tuple[dict, int] | None:
    """``chosen_molecules`` of one structure: the molecule and its copies. Only molecules that are as good but for their copies are signed."""
    rank = lambda m: (lambda c: (c > 0, m["n_atoms"], c))(int((re.search(r"C(\d+)", m["formula"]) or (0, 0))[1]))
    some = [(rank(m), m) for m in molecules if m["formula"] != b.WATER]
    if not some:
        return None
    top = max(r for r, _ in some)
    best = sorted((m for r, m in some if r == top), key=lambda m: m["component"])
    if len(best) == 1:
        return best[0], 1
    names: dict[str, list[dict]] = {}
    for m in best:
        own = atoms[m["component"]]
        at = {p["atom_idx"]: k for k, p in enumerate(own)}
        near = [(at[e["i"]], at[e["j"]]) for e in links if e["i"] in at] if len(own) > 1 else []
        names.setdefault(b.refined([p["element"] for p in own], near), []).append(m)
    first = max(names.values(), key=len)  # of equally many the earliest
    return first[0], len(first)


def of_interest(molecules: DataFrame) -> DataFrame:
    """(structure_id, component, n_atoms, formula, copies, rows) of the chosen molecules: their Z-matrix rows, each with the kind of its dihedral.

    ``molecules`` are structures as one row each, with the fields of
    ``bonded.structures``; all that concerns one is worked out in its row.
    """
    fields = {"component": "int", "n_atoms": "long", "formula": "string", "copies": "long"}
    row = zmatrix.ROW | {"kind": "string"}
    kinds = pa.struct([(n, zmatrix.ARROW[k]) for n, k in row.items()])

    def made(record):
        atoms: dict[int, list[dict]] = {}
        for p in record["atoms"]:
            atoms.setdefault(p["component"], []).append(p)
        found = chosen(record["molecules"], atoms, record["links"])
        if found is None:
            return None
        molecule, copies = found
        rows = list(zmatrix.lined_up(atoms[molecule["component"]], record["links"]))
        place = {r[2]: r[1] for r in rows}
        links = {(place[e[x]], place[e[y]]) for e in record["links"] if e["i"] in place and e["j"] in place for x, y in ("ij", "ji")}
        named = [dict(zip(zmatrix.ROW, r)) for r in rows]
        for r in named:
            r["kind"] = None if r["dihedral_to"] is None else zmatrix.kind_of(r["bond_to"], r["angle_to"], r["dihedral_to"], links)
        return molecule["component"], molecule["n_atoms"], molecule["formula"], copies, named

    def run(record_batches):
        for whole in record_batches:
            for lo, hi in batches.blocks(np.diff(whole.column("atoms").offsets.to_numpy()), zmatrix.STEP):
                batch = whole.slice(lo, hi - lo)
                done = [made(r) for r in batch.select(["atoms", "links", "molecules"]).to_pylist()]
                kept = [x for x in done if x is not None]
                columns = list(zip(*kept)) or [()] * (len(fields) + 1)
                arrays = [pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.list_(kinds)))]
                ids = batch.column("structure_id").take(pa.array([k for k, x in enumerate(done) if x is not None], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *arrays], names=["structure_id", *fields, "rows"])

    each = ", ".join(f"{n}: {k}" for n, k in row.items())
    schema = ", ".join([f"structure_id {dict(molecules.dtypes)['structure_id']}", *[f"{n} {k}" for n, k in fields.items()], f"rows array<struct<{each}>>"])
    return molecules.select("structure_id", "atoms", "links", "molecules").mapInArrow(run, schema)


def open_bonds(points: DataFrame, elements: DataFrame, scale: float = 1.2, keys: list[str] = ["mol_id"]) -> DataFrame:  # noqa: B006
    """(keys, i, j, distance) of points (keys, idx, element, x, y, z) without a cell, at most ``scale`` radius sums apart.

    Space is cut into boxes; the larger atom of a pair looks for the other in
    the boxes that its reach touches, so the work grows with the points.
    """
    df = points.join(F.broadcast(elements.select("element", "radius")), "element", "left")
    df = df.withColumn("radius", dims.known(df, "radius"))
    columns = ["idx", "radius", "x", "y", "z"]
    boxes = [F.floor(F.col(c) / b.BOX).alias(f"_b{c}") for c in "xyz"]
    reach = 2 * scale * F.col("radius") + 1e-9
    left = df.select(*keys, F.struct(*columns).alias("a"), *[F.sequence(F.floor((F.col(c) - reach) / b.BOX), F.floor((F.col(c) + reach) / b.BOX)).alias(f"_b{c}") for c in "xyz"])
    for c in "xyz":
        left = left.withColumn(f"_b{c}", F.explode(f"_b{c}"))
    right = df.select(*keys, F.struct(*columns).alias("b"), *boxes)
    met = left.join(right, [*keys, "_bx", "_by", "_bz"]).where("a.radius > b.radius OR a.radius = b.radius AND a.idx < b.idx")
    met = met.select(*keys, F.least("a.idx", "b.idx").alias("i"), F.greatest("a.idx", "b.idx").alias("j"), (F.col("a.radius") + F.col("b.radius")).alias("_sum"), g.norm(tuple(F.col(f"b.{c}") - F.col(f"a.{c}") for c in "xyz")).alias("distance"))
    return met.where(F.col("distance") <= scale * F.col("_sum")).select(*keys, "i", "j", "distance")


def merged_bonds(keys: list[str], **sources: DataFrame) -> DataFrame:
    """Union of links (keys, i, j) with the name of the first source that has each; pairs are unordered, links to oneself are left out."""
    parts = [df.select(*keys, F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), F.lit(k).alias("_rank"), F.lit(name).alias("kind")) for k, (name, df) in enumerate(sources.items())]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.where("i < j").groupBy(*keys, "i", "j").agg(F.min_by("kind", "_rank").alias("kind"))


def geometry_warnings(rows: DataFrame, points: DataFrame, tolerance: float = 1e-5) -> DataFrame:
    """(mol_id, row_index, warning) of rows whose lengths, angles or dihedrals differ from those of the points."""
    names = {"bond": "bond_length", "angle": "angle_deg", "dihedral": "dihedral_deg"}
    df = zmatrix.measures(rows, points)
    off = {k: g.wrapped_difference(F.col(f"m_{c}") - F.col(c)) if k == "dihedral" else F.col(f"m_{c}") - F.col(c) for k, c in names.items()}
    made = F.array(*[F.when(F.abs(d) > tolerance, F.lit(f"{k} differs")) for k, d in off.items()])
    return df.select("mol_id", "row_index", F.explode(F.filter(made, lambda x: x.isNotNull())).alias("warning"))


def template_bonds(template: DataFrame, atoms: DataFrame) -> DataFrame:
    """Bonds of a template (structure_id, i, j) on the atoms' current places: nearest image and its distance."""
    ends = []
    for k, name in ((1, "i"), (2, "j")):
        extra = list(g.LATTICE) if k == 1 else []
        ends.append(atoms.select("structure_id", F.col("atom_idx").alias(name), *extra, *[F.col(f"f{c}").alias(f"f{c}{k}") for c in "xyz"]))
    df = template.select("structure_id", "i", "j").join(ends[0], ["structure_id", "i"]).join(ends[1], ["structure_id", "j"])
    f, h = (tuple(F.col(f"f{c}{k}") for c in "xyz") for k in (1, 2))
    return df.select("structure_id", "i", "j", *[(-F.rint(F.col(f"f{c}2") - F.col(f"f{c}1"))).cast("int").alias(f"s{c}") for c in "xyz"], g.nearest_image(f, h).alias("distance"))


def projection(points: DataFrame) -> DataFrame:
    """(structure_id, atom_idx, u, v): points on their two principal axes; x and y for at most two points.

    An axis points to the side of its largest component.
    """
    rows = points.groupBy("structure_id").agg(F.array_sort(F.collect_list(F.struct("atom_idx", "x", "y", "z"))).alias("points"))

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                xyz = np.array([[p["x"], p["y"], p["z"]] for p in r.points])
                flat = xyz[:, :2]
                if len(xyz) > 2:
                    axes = np.linalg.svd(xyz - xyz.mean(axis=0), full_matrices=False)[2][:2]
                    axes = axes * np.sign(axes[np.arange(2), np.abs(axes).argmax(axis=1)])[:, None]
                    flat = (xyz - xyz.mean(axis=0)) @ axes.T
                out += [(r.structure_id, p["atom_idx"], *f.tolist()) for p, f in zip(r.points, flat)]
            yield pd.DataFrame(out, columns=["structure_id", "atom_idx", "u", "v"])

    return rows.mapInPandas(run, f"structure_id {dict(rows.dtypes)['structure_id']}, atom_idx int, u double, v double")


def axis_limits(points: DataFrame, column: str, padding: float = 0.05) -> DataFrame:
    """One row (low, high): the range of a column widened by a share of itself, or by one if it has no width."""
    low, high = F.min(column), F.max(column)
    pad = F.when(high == low, F.lit(1.0)).otherwise((high - low) * padding)
    return points.agg((low - pad).alias("low"), (high + pad).alias("high"))


def latest_path(files: DataFrame, order: str) -> DataFrame:
    """(system, path) of the last of a system's files (system, relative_path, path) by ``text``, ``depth`` or ``chain``."""
    parts = F.split("relative_path", "/")
    numbers = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda x: F.coalesce(x.try_cast("int"), F.lit(-1)))
    keys = {"text": F.struct("relative_path"), "depth": F.struct(F.size(parts), "relative_path"), "chain": F.struct(F.size(parts), numbers, "relative_path")}
    return files.groupBy("system").agg(F.max_by("path", keys[order]).alias("path"))


def system_of_stage(name: Column) -> tuple[Column, Column]:
    """System and stage of a file name ``system_stage_CONTCAR.cif``, cut at the last underscore before the ending."""
    stem = F.regexp_replace(name, r"_CONTCAR\.cif$", "")
    return F.regexp_replace(stem, "_[^_]*$", ""), F.substring_index(stem, "_", -1)
