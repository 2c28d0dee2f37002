"""Text of structure files and input decks, one row a file: ordered rows joined inside the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from crystalspark.functions import geometry as g

#: Spacing of k-points in reciprocal Angstrom (fixed value).
SPACING = 0.025 * 2 * math.pi
CELL = ["a", "b", "c", "alpha", "beta", "gamma"]


def _joined(order: list[str], line: Column) -> Column:
    """Lines of a group in the given order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, line.alias("line")))), lambda x: x["line"]), "\n")


def cif(atoms: DataFrame) -> DataFrame:
    """(structure_id, text): cell and coordinates with ten decimals; no symmetry loop."""
    row = F.format_string("%s %s %.10f %.10f %.10f 1.0", "label", "element", "fx", "fy", "fz")
    tags = ["_cell_length_a", "_cell_length_b", "_cell_length_c", "_cell_angle_alpha", "_cell_angle_beta", "_cell_angle_gamma"]
    head = F.concat(F.format_string("data_%s\n_symmetry_space_group_name_H-M 'P 1'\n_crystalspark_explict_unit_cell true\n", F.col("structure_id").cast("string")), *[F.format_string(f"{t} %.10f\n", F.col(c)) for t, c in zip(tags, CELL)])
    loop = F.lit("loop_\n_atom_site_label\n_atom_site_type_symbol\n_atom_site_fract_x\n_atom_site_fract_y\n_atom_site_fract_z\n_atom_site_occupancy\n")
    return atoms.groupBy("structure_id", *CELL).agg(_joined(["atom_idx"], row).alias("_rows")).select("structure_id", F.concat(head, loop, "_rows", F.lit("\n")).alias("text"))


def pdb(atoms: DataFrame, space_group: str = "P 1") -> DataFrame:
    """(structure_id, text) with fixed columns; labels are cut to four characters."""
    row = F.format_string("HETATM%5d %-4s MOL     1    %8.3f%8.3f%8.3f  1.00  0.00          %2s", F.col("atom_idx") + 1, F.substring("label", 1, 4), "x", "y", "z", "element")
    head = F.format_string(f"CRYST1%9.3f%9.3f%9.3f%7.2f%7.2f%7.2f {space_group}\n", *[F.col(c) for c in CELL])
    return atoms.groupBy("structure_id", *CELL).agg(_joined(["atom_idx"], row).alias("_rows")).select("structure_id", F.concat(head, "_rows", F.lit("\nEND\n")).alias("text"))


def _element_order(atoms: DataFrame) -> DataFrame:
    """Adds ``_first``, the index at which an atom's element first appears in its structure."""
    return atoms.withColumn("_first", F.min("atom_idx").over(W.partitionBy("structure_id", "element")))


def poscar(atoms: DataFrame) -> DataFrame:
    """(structure_id, text): atoms grouped by element in order of first appearance, Cartesian."""
    df = _element_order(atoms)
    vectors = F.array_join(F.array(*[F.format_string("%15.12f %15.12f %15.12f", *[F.col(c) for c in g.LATTICE[k : k + 3]]) for k in (0, 3, 6)]), "\n")
    row = F.format_string("%15.12f %15.12f %15.12f", "x", "y", "z")
    kinds = df.groupBy("structure_id", "element", "_first").agg(F.count("*").alias("n")).groupBy("structure_id").agg(F.array_sort(F.collect_list(F.struct("_first", "element", "n"))).alias("k"))
    body = df.groupBy("structure_id", *g.LATTICE).agg(_joined(["_first", "atom_idx"], row).alias("_rows")).join(kinds, "structure_id")
    names, counts = F.array_join(F.transform("k", lambda x: x["element"]), "  "), F.array_join(F.transform("k", lambda x: x["n"].cast("string")), "  ")
    return body.select("structure_id", F.concat_ws("\n", F.col("structure_id").cast("string"), F.lit("1.00"), vectors, names, counts, F.lit("Cartesian"), "_rows", F.lit("")).alias("text"))


def res(atoms: DataFrame, lattice: Column, operations: Column) -> DataFrame:
    """(structure_id, text) in SHELX form; ``operations`` is an array of written operations."""
    df = _element_order(atoms).withColumns({"_latt": lattice, "_ops": operations})
    kinds = df.groupBy("structure_id").agg(F.transform(F.array_sort(F.collect_set(F.struct("_first", "element"))), lambda x: x["element"]).alias("_kinds"))
    df = df.join(kinds, "structure_id")
    row = F.format_string("%s %d %.10f %.10f %.10f", "label", F.array_position("_kinds", F.col("element")).cast("int"), "fx", "fy", "fz")
    head = F.concat(F.format_string("TITL %s\nCELL 0.71073 %.10f %.10f %.10f %.10f %.10f %.10f\nLATT %d\n", F.col("structure_id").cast("string"), *[F.col(c) for c in CELL], F.col("_latt").cast("int")), F.array_join(F.transform("_ops", lambda o: F.concat(F.lit("SYMM "), o, F.lit("\n"))), ""), F.lit("SFAC "), F.array_join("_kinds", " "), F.lit("\n"))
    body = df.groupBy("structure_id", *CELL, "_latt", "_ops", "_kinds").agg(_joined(["atom_idx"], row).alias("_rows"))
    return body.select("structure_id", F.concat(head, "_rows", F.lit("\nEND\n")).alias("text"))


def kpoint_grid(spacing: float = SPACING) -> list[Column]:
    """Three grid numbers of the lattice columns: ceilings of the reciprocal lengths over the spacing (to nine decimals), at least one."""
    return [F.greatest(F.lit(1), F.ceil(F.round(g.norm(v) / spacing, 9))).cast("int") for v in g.reciprocal()]


def kpoints(structures: DataFrame, spacing: float = SPACING) -> DataFrame:
    return structures.select("structure_id", F.concat(F.lit("AutoKPOINTS\n0\nGamma\n "), F.concat_ws(" ", *[c.cast("string") for c in kpoint_grid(spacing)]), F.lit("\n 0 0 0\n")).alias("text"))


def zmatrix(rows: DataFrame) -> DataFrame:
    """(mol_id, text) of numeric Z-matrix rows with ten decimals."""
    ten = lambda c: F.when(F.col(c).isNotNull(), F.format_string("%.10f", c))
    row = F.concat_ws(" ", "element", "bond_to", ten("bond_length"), "angle_to", ten("angle_deg"), "dihedral_to", ten("dihedral_deg"))
    return rows.groupBy("mol_id").agg(_joined(["row_index"], row).alias("_rows")).select("mol_id", F.concat(F.lit("# ZMAT v1\n# title: "), "mol_id", F.lit("\n"), "_rows", F.lit("\n")).alias("text"))


def fill(template: str, values: dict[str, Column]) -> Column:
    """A template with its placeholders replaced."""
    out = F.lit(template)
    for k, v in values.items():
        out = F.replace(out, F.lit(k), v)
    return out


#: Settings of a gas-phase deck by line prefix (fixed values).
GAS_PHASE = {"SIGMA": "SIGMA = 0.01", "ISMEAR": "ISMEAR = 0", "NSW": "NSW = 0", "IBRION": "IBRION = -1"}


def gas_phase(deck: Column) -> Column:
    """A crystal deck with the lines of GAS_PHASE rewritten."""
    def line(x: Column) -> Column:
        out = x
        for prefix, value in GAS_PHASE.items():
            out = F.when(F.ltrim(x).startswith(prefix), F.lit(value)).otherwise(out)
        return out

    return F.array_join(F.transform(F.split(deck, "\n"), line), "\n")


#: What each format is written by; ``res`` also takes the lattice number and the operations, none given means a full cell without symmetry.
FORMATS = ("cif", "pdb", "poscar", "res")


def text_of(atoms: DataFrame, fmt: str, lattice: Column | None = None, operations: Column | None = None) -> DataFrame:
    """(structure_id, text) of structures in one of FORMATS; a name with a dot gives the format by its ending."""
    kind = fmt.rsplit(".", 1)[-1].lower()
    if kind not in FORMATS:
        raise ValueError(f"unsupported format {fmt}")
    if kind == "res":
        return res(atoms, F.lit(-1) if lattice is None else lattice, F.array().cast("array<string>") if operations is None else operations)
    return {"cif": cif, "pdb": pdb, "poscar": poscar}[kind](atoms)


def save(texts: DataFrame, path: str, name: str = "structure_id") -> None:
    """Write (name, text) rows as one text file a folder, through Spark's committer."""
    texts.select(F.col(name).cast("string").alias("name"), F.col("text").alias("value")).write.partitionBy("name").mode("errorifexists").text(path)
