"""Elements of the whole table, signatures of molecules that differ far out, neighbours in flat cells."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from crystalspark.functions import text as t
from crystalspark.operators import bonds, dims, pdd
from crystalspark.sources import structures

SYMBOLS = ["Cu", "CU", "cu", "Na", "B", "Br1", "Se", "Hg", "Fe2+", "Co", "Ca", "Ni", "K", "Zn", "D", "T", "H1A", "Xx", "Cx9", "U", "Si"]
WANT = ["Cu", "Cu", "Cu", "Na", "B", "Br", "Se", "Hg", "Fe", "Co", "Ca", "Ni", "K", "Zn", "H", "H", "H", None, "C", "U", "Si"]


def test_elements(spark):
    assert [t.element_symbol(s, dims.ELEMENTS) for s in SYMBOLS] == WANT
    df = spark.createDataFrame(list(enumerate(SYMBOLS)), "i int, s string").select("i", t.normal_element(F.col("s"), list(dims.ELEMENTS)).alias("e"))
    assert [r.e for r in df.orderBy("i").collect()] == WANT
    assert structures.element("Cu1") == "Cu"
    with pytest.raises(ValueError):
        structures.element("Xx")
    numbers = [v[0] for v in dims.ELEMENTS.values()]
    assert numbers == list(range(1, 97)) and dims.ELEMENTS["Br"][:3] == (35, 1.20, 79.904) and dims.ELEMENTS["Cm"][0] == 96


LATTICE = {"ax": 3.0, "ay": 0.0, "az": 0.0, "bx": 0.0, "by": 20.0, "bz": 0.0, "cx": 0.0, "cy": 0.0, "cz": 20.0}


def points(spark, rows, lattice=LATTICE):
    df = spark.createDataFrame(rows, "structure_id long, atom_idx int, element string, x double, y double, z double")
    return df.select("*", *[F.lit(float(v)).alias(k) for k, v in lattice.items()])


def test_atoms_of_any_element_stay_and_unknown_ones_raise(spark):
    atoms = points(spark, [(1, 0, "Na", 0.0, 1.0, 1.0), (1, 1, "C", 1.0, 10.0, 10.0), (1, 2, "C", 2.4, 10.0, 10.0)], LATTICE | {"ax": 12.0})
    near = bonds.contacts(atoms)
    found = bonds.molecules(atoms, bonds.components(atoms, near))
    assert sorted(r.formula for r in found.collect()) == ["C2", "Na1"]
    with pytest.raises(Exception, match="no mass is known"):
        other = atoms.withColumn("element", F.when(F.col("atom_idx") == 0, "Qq").otherwise(F.col("element")))
        bonds.molecules(other, bonds.components(atoms, near)).collect()


def test_neighbours_in_flat_and_skew_cells(spark):
    near = pdd.nearest(points(spark, [(1, 0, "C", 0.0, 0.0, 0.0)]), 4).orderBy("rank").collect()
    assert [r.distance for r in near] == [3.0, 3.0, 6.0, 6.0]
    rng = random.Random(3)
    for _ in range(4):
        cell = np.array([[rng.uniform(2, 9), 0, 0], [rng.uniform(-4, 4), rng.uniform(3, 9), 0], [rng.uniform(-4, 4), rng.uniform(-4, 4), rng.uniform(2, 12)]])
        motif = np.array([[rng.uniform(-1, 2) for _ in range(3)] for _ in range(3)]) @ cell
        lattice = {f"{v}{c}": cell[i, j] for i, v in enumerate("abc") for j, c in enumerate("xyz")}
        got = pdd.nearest(points(spark, [(1, i, "C", *map(float, p)) for i, p in enumerate(motif)], lattice), 9).orderBy("i", "rank").collect()
        assert np.allclose([r.distance for r in got], pdd.nearest_neighbours(motif, cell, 9).ravel())


def chain(n, branch):
    """Carbon skeleton: a chain of n with a carbon on atom ``branch``."""
    return ["C"] * (n + 1), [(i, i + 1) for i in range(n - 1)] + [(branch, n)]


def test_signatures_see_as_far_as_the_molecule(spark):
    assert bonds.refined(*chain(13, 4)) != bonds.refined(*chain(13, 5))
    assert bonds.refined(*chain(13, 4)) == bonds.refined(*chain(13, 8))
    rng, rows, links, parts = random.Random(1), [], [], []
    for s, branch in enumerate((4, 5, 8)):
        elements, pairs = chain(13, branch)
        order = list(range(14))
        rng.shuffle(order)
        rows += [(s, order[i], e) for i, e in enumerate(elements)]
        parts += [(s, i, 0) for i in range(14)]
        links += [(s, min(order[i], order[j]), max(order[i], order[j])) for i, j in pairs]
    signed = bonds.signatures(spark.createDataFrame(rows, "structure_id long, atom_idx int, element string"), spark.createDataFrame(links, "structure_id long, i int, j int"), spark.createDataFrame(parts, "structure_id long, atom_idx int, component int"))
    a, b, c = [r.signature for r in signed.orderBy("structure_id").collect()]
    assert a == c != b


def brute_contacts(motif, cell, radii, scale=1.2):
    """Shortest image of each pair within the scaled radius sum, over a wide block of cells."""
    found = {}
    steps = np.array([(i, j, k) for i in range(-6, 7) for j in range(-6, 7) for k in range(-6, 7)])
    shifts = steps @ cell
    for i in range(len(motif)):
        for j in range(i + 1, len(motif)):
            d = np.linalg.norm(motif[j] - motif[i] + shifts, axis=1)
            h = 0.31 in (radii[i], radii[j])
            if d.min() <= (radii[i] + radii[j]) * (1.3 if h else scale):
                found[i, j] = round(float(d.min()), 9)
    return found


def test_bonds_of_any_coordinates_and_thin_cells(spark):
    rng = random.Random(8)
    radius = {"C": 0.76, "H": 0.31, "S": 1.05}
    for trial in range(4):
        size = 3 if trial < 2 else 14
        cell = np.array([[rng.uniform(2, size), 0, 0], [rng.uniform(-3, 3), rng.uniform(2, size), 0], [rng.uniform(-3, 3), rng.uniform(-3, 3), rng.uniform(2, size)]])
        motif = np.array([[rng.uniform(-1.9, 2.9) for _ in range(3)] for _ in range(6 if trial < 2 else 40)]) @ cell
        kinds = [rng.choice("CHS") for _ in motif]
        lattice = {f"{v}{c}": cell[i, j] for i, v in enumerate("abc") for j, c in enumerate("xyz")}
        atoms = points(spark, [(1, i, e, *map(float, p)) for i, (e, p) in enumerate(zip(kinds, motif))], lattice)
        rows = bonds.contacts(atoms).collect()
        assert {(r.i, r.j): round(r.distance, 9) for r in rows} == brute_contacts(motif, cell, [radius[e] for e in kinds])
        for r in rows:
            assert abs(np.linalg.norm(motif[r.j] - motif[r.i] + np.array([r.sx, r.sy, r.sz]) @ cell) - r.distance) < 1e-9


def test_bonds_of_a_large_cell_cost_its_atoms_not_its_pairs(spark):
    n, edge = 15, 3.0  # a lattice of 3,375 pairs of carbons, each bonded along x only
    cell = {k: 0.0 for k in LATTICE} | {"ax": n * edge, "by": n * edge, "cz": n * edge}
    rows = []
    for i in range(n):
        for j in range(n):
            for k in range(n):
                rows += [(1, 2 * len(rows) // 2, "C", i * edge, j * edge, k * edge), (1, len(rows) + 1, "C", i * edge + 1.4, j * edge, k * edge)]
    rows = [(1, at, *r[2:]) for at, r in enumerate(rows)]
    atoms = points(spark, rows, cell)
    assert bonds.contacts(atoms).count() == 2 * n**3  # 1.4 along, and 1.6 on to the next pair round the edge
    met = bonds.neighbours(atoms.withColumn("radius", F.lit(0.76)), "2D", ["radius", "x"], "a.k < b.k").count()
    assert met < 60 * len(rows)  # of 22,781,250 pairs


def test_open_bonds_against_all_pairs(spark):
    from crystalspark.operators import dims, reports

    rng = random.Random(9)
    where = [(m, i, rng.choice(["C", "H", "O"]), *[rng.uniform(-9, 9) for _ in range(3)]) for m in "ab" for i in range(60)]
    df = spark.createDataFrame(where, "mol_id string, idx int, element string, x double, y double, z double")
    radius = {"C": 0.76, "H": 0.31, "O": 0.66}
    expected = {(p[0], p[1], q[1]) for p in where for q in where if p[0] == q[0] and p[1] < q[1] and np.linalg.norm(np.array(p[3:]) - np.array(q[3:])) <= 1.2 * (radius[p[2]] + radius[q[2]])}
    assert {(r.mol_id, r.i, r.j) for r in reports.open_bonds(df, dims.elements(spark)).collect()} == expected
