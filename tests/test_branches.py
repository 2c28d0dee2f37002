"""The branch report works on one row a structure."""

from pyspark.sql import functions as F

from crystalspark.operators import bonded, bonds, reports, zmatrix
from tests.test_bonded import atoms, plan_of, same  # noqa: F401


def test_a_branch_report_takes_one_shuffle(spark, atoms):  # noqa: F811
    rows = bonded.structures(atoms.repartition("structure_id"), "atoms", "links", "molecules", unwrapped=True)
    assert plan_of(reports.of_interest(rows)).count("Exchange") == 1


def test_branch_report_chooses_and_counts_as_the_relations_do(spark, atoms):  # noqa: F811
    kinds = ("proper", "improper", "fallback", "ambiguous")
    rows, report = reports.branch_report(atoms)
    near = bonds.single_hydrogen_bonds(bonds.contacts(atoms))
    parts = bonds.components(atoms, near)
    chosen = reports.chosen_molecules(bonds.molecules(atoms, parts), bonds.signatures(atoms, near, parts))
    same(report.select(*chosen.columns), chosen)
    place = rows.select("structure_id", "atom_idx", "row_index")
    links = near.select("structure_id", "i", "j")
    for k in "ij":
        links = links.join(place.select("structure_id", F.col("atom_idx").alias(k), F.col("row_index").alias(f"r{k}")), ["structure_id", k])
    links = links.select(F.col("structure_id").alias("mol_id"), F.least("ri", "rj").alias("a"), F.greatest("ri", "rj").alias("b"))
    named = rows.withColumnRenamed("structure_id", "mol_id")
    counted = zmatrix.dihedral_kinds(named, links).groupBy("mol_id").agg(*[F.count_if(F.col("kind") == k).alias(f"{k}_count") for k in kinds])
    same(report.where(" + ".join(f"{k}_count" for k in kinds) + " > 0").select(F.col("structure_id").alias("mol_id"), *[f"{k}_count" for k in kinds]), counted)
    checked = zmatrix.problems(named).groupBy("mol_id").agg(F.count("*").alias("entry_count"), F.max(F.size("warnings")).alias("warning_count"), F.count_if(F.size("errors") > 0).alias("validation_error_count"))
    same(report.select(F.col("structure_id").alias("mol_id"), "entry_count", "warning_count", "validation_error_count"), checked)
