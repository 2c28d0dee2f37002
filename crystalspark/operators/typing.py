"""Force-field atom types from bonds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crystalspark.functions import text as t
from crystalspark.operators import bonded


def types(atoms: DataFrame, label_type: str = "fit") -> DataFrame:
    """(structure_id, atom_idx, element, site_type, error): heavy atoms by element, hydrogens by their one heavy neighbour."""
    if label_type not in ("fit", "fit_hp"):
        raise ValueError(f"unknown label type {label_type!r}")
    joined = bonded.heavy_neighbours(atoms)
    hydrogen = F.col("element") == "H"
    kind = F.when(~hydrogen, t.heavy_type(F.col("element"))).when(F.col("n") == 1, t.hydrogen_type(F.col("parent"), label_type))
    problem = F.when(hydrogen & F.col("n").isNull(), "no heavy neighbour").when(hydrogen & (F.col("n") > 1), "several heavy neighbours").when(kind.isNull(), "unsupported neighbour")
    return joined.select("structure_id", "atom_idx", "element", kind.alias("site_type"), problem.alias("error"))


def missing_types(typed: DataFrame, allowed: DataFrame) -> DataFrame:
    """Site types of structures that a potential (column site_type) has no parameters for."""
    return typed.where("site_type IS NOT NULL").select("structure_id", "site_type").distinct().join(F.broadcast(allowed.select("site_type").distinct()), "site_type", "left_anti")


def type_counts(typed: DataFrame) -> DataFrame:
    return typed.where("site_type IS NOT NULL").groupBy("structure_id", "site_type").agg(F.count("*").alias("n"))
