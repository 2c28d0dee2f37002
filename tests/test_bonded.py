"""What follows from the bonds of a structure is worked out in its row, without a shuffle of its own."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from crystalspark.functions import geometry as g
from crystalspark.operators import bonded, bonds, corpus, typing, zmatrix


@pytest.fixture(scope="module")
def atoms(spark):
    rng, rows = random.Random(4), []
    for s in range(60):
        cell = [rng.uniform(3, 9), 0.0, 0.0, rng.uniform(-2, 2), rng.uniform(3, 9), 0.0, rng.uniform(-2, 2), rng.uniform(-2, 2), rng.uniform(3, 14)]
        for i in range(rng.choice((1, 2, 5, 30))):
            f = np.array([rng.uniform(-1.5, 2.5) for _ in range(3)])
            rows.append((s, i, rng.choice(["C", "H", "H", "O", "S"]), *map(float, f), *cell, *map(float, f @ np.array(cell).reshape(3, 3))))
    names = ", ".join(f"{c} double" for c in ("fx", "fy", "fz", *g.LATTICE, "x", "y", "z"))
    return spark.createDataFrame(rows, f"structure_id long, atom_idx int, element string, {names}").repartition(5).localCheckpoint()


def same(one, other):
    assert sorted(one.columns) == sorted(other.columns)
    one, other = (sorted(map(tuple, df.select(*sorted(one.columns)).collect()), key=str) for df in (one, other))
    assert one == other and one


def test_molecules_in_a_row_are_those_of_the_joins(spark, atoms):
    near = bonds.contacts(atoms)
    parts = bonds.components(atoms, near)
    rows = bonded.structures(atoms, "atoms", "links", "molecules")
    each = rows.select("structure_id", F.inline("atoms"))
    same(each.select("structure_id", "atom_idx", "component"), parts)
    same(rows.select("structure_id", F.inline("links")), near.select("structure_id", "i", "j"))
    rounded = F.round("weight", 6).alias("weight")
    made, joined = (m.select("structure_id", "component", "n_atoms", "n_heavy", rounded, "formula") for m in (rows.select("structure_id", F.inline("molecules")), bonds.molecules(atoms, parts)))
    same(made, joined)
    same(bonds.signed_rows(rows), bonds.signatures(atoms, near, parts))


def test_hydrogens_keep_one_bond(spark, atoms):
    near = bonds.contacts(atoms)
    same(bonded.bond_rows(atoms, list("xyz"), lambda a: a.contacts().single_hydrogen()), bonds.single_hydrogen_bonds(near))
    assert bonds.single_hydrogen_bonds(near).count() < near.count()


def test_unwrapped_atoms_move_by_whole_cells_and_lie_along_a_tree_of_bonds(spark, atoms):
    whole = atoms.join(bonded.structures(atoms, "atoms", unwrapped=True).select("structure_id", F.inline("atoms")).select("structure_id", "atom_idx", "component", *[F.col(c).alias(f"u{c}") for c in "xyz"]), ["structure_id", "atom_idx"]).toPandas()
    links = bonds.contacts(atoms).toPandas()
    for s, own in whole.groupby("structure_id"):
        own = own.set_index("atom_idx").sort_index()
        cell = own[list(g.LATTICE)].to_numpy()[0].reshape(3, 3)
        moved = (own[["ux", "uy", "uz"]].to_numpy() - own[list("xyz")].to_numpy()) @ np.linalg.inv(cell)
        assert np.allclose(moved, np.rint(moved), atol=1e-9)
        label = list(range(len(own)))  # bonds of their own length have to hold each molecule together
        for e in links[links.structure_id == s].itertuples():
            if abs(np.linalg.norm(own.loc[e.i, ["ux", "uy", "uz"]].astype(float) - own.loc[e.j, ["ux", "uy", "uz"]].astype(float)) - e.distance) < 1e-9:
                a, b = label[e.i], label[e.j]
                label = [min(a, b) if x in (a, b) else x for x in label]
        assert label == own["component"].tolist()


def test_types_by_the_pair_cutoffs(spark, atoms):
    near = bonds.pair_table_bonds(atoms).toPandas()
    ends = pd.concat([near.rename(columns={"i": "k", "element1": "e", "element2": "o"}), near.rename(columns={"j": "k", "element2": "e", "element1": "o"})])
    heavy = ends[(ends.e == "H") & (ends.o != "H")].groupby(["structure_id", "k"]).o.agg(["size", "min"])
    found = {(r.structure_id, r.atom_idx): (r.site_type, r.error) for r in typing.types(atoms).collect() if r.element == "H"}
    assert len(heavy) > 3 and {k for k, v in found.items() if v[1] != "no heavy neighbour"} == set(heavy.index)
    for k, (n, o) in heavy.iterrows():
        assert found[k] == ((None, "several heavy neighbours") if n > 1 else ({"C": "H_c", "S": "H_c", "O": "H_o"}[o], None))


def plan_of(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))


def test_all_that_concerns_a_structure_takes_one_shuffle(spark, atoms):
    one = atoms.repartition("structure_id")
    rows = bonded.structures(one, "atoms", "links", "molecules", unwrapped=True)
    for df in (bonds.contacts(one), rows, zmatrix.generate_rows(rows), typing.types(one)):
        assert plan_of(df).count("Exchange") == 1


def test_structures_may_be_missing_places_or_all_atoms(spark, atoms):
    assert bonded.structures(atoms.where("false"), *bonded.FIELDS).count() == bonds.contacts(atoms.where("false")).count() == 0
    lost = atoms.withColumns({c: F.when(F.col("atom_idx") != 1, F.col(c)) for c in ("x", "y", "z", "fx", "fy", "fz")})
    for find in (bonds.contacts, bonds.pair_table_bonds):
        expected = find(atoms).where("i <> 1 AND j <> 1").select("structure_id", "i", "j")
        same(find(lost).select("structure_id", "i", "j"), expected)
    with pytest.raises(Exception, match="no radius is known for element Qq"):
        bonds.contacts(atoms.withColumn("element", F.lit("Qq"))).collect()


def test_the_corpus_is_dealt_once_by_structure(spark, tmp_path):
    rows = [(i % 9, i // 9 + 1, i, i, float(i), float(i), "x") for i in range(50)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_shipdate string").write.parquet(str(tmp_path / "lineitem.parquet"))
    grouped = corpus.atoms(spark, str(tmp_path)).groupBy("structure_id").agg(F.collect_list("fx"))
    assert plan_of(grouped).count("Exchange") == 1 and grouped.count() == 9


def test_hydrogens_and_rigid_molecules_need_no_shuffle_of_their_own(spark, tmp_path):
    from crystalspark.plans import catalog, reports  # noqa: F401

    rows = [(i % 9, i // 9 + 1, i, i, float(i), float(i), "x") for i in range(50)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_shipdate string").write.parquet(str(tmp_path / "lineitem.parquet"))
    for name, most in (("bond_shortest_per_h", 1), ("rigid_info_deck", 2)):
        plan = plan_of(catalog.queries()[name](spark, str(tmp_path)))
        assert plan.count("Exchange") <= most and "Join" not in plan, name
