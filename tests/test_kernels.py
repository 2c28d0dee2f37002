import itertools
from fractions import Fraction

import numpy as np
import pytest

from crystalspark.operators import cells, pdd, symmetry, zmatrix
from crystalspark.operators.corpus import GROUPS
from crystalspark.sources import structures as st


def test_symmetry_text():
    assert symmetry.parse("-x, 1/2+y ,z-1/3") == (((-1, 0, 0), (0, 1, 0), (0, 0, 1)), (Fraction(0), Fraction(1, 2), Fraction(-1, 3)))
    assert symmetry.written(symmetry.parse("x+1/2,-y,1/3-z")) == "1/2+X,-Y,1/3-Z"
    assert symmetry.parse("0.75+x,y,z", strict=True)[1][0] == Fraction(3, 4)
    assert symmetry.parse("0.75+x,y,z")[1][0] == Fraction(3, 4)
    for bad in ("x,y", "x+x,y,z", "x,y,__import__('os')"):
        with pytest.raises(ValueError):
            symmetry.parse(bad)
    found = symmetry.support(["x,y,z", "0.4+x,y,z"])
    assert found["parsed"] == ["X,Y,Z"] and found["unsupported"] == ["0.4+x,y,z"]


def test_symmetry_records_round_trip():
    for group in GROUPS.values():
        number, kept = symmetry.symmetry_records(group)
        full = {(r, tuple(t % 1 for t in s)) for r, s in map(symmetry.parse, group)}
        assert set(symmetry.full_operations(kept, number)) == full
    assert symmetry.symmetry_records(GROUPS[3])[0] == 7 and symmetry.symmetry_records(GROUPS[2])[0] == -1
    assert symmetry.distinct(GROUPS[3], 7) == GROUPS[3][:4]


def test_greedy_sites_depend_on_order():
    cell, e = np.eye(3) * 10, np.array(["C", "C", "C", "N"])
    points = np.array([[0.0, 0, 0], [0.0009, 0, 0], [0.0018, 0, 0], [0.9999, 0, 0]])
    assert cells.greedy_sites(points, e, cell).tolist() == [0, 2, 3]
    assert cells.greedy_sites(points[[1, 0, 2, 3]], e, cell).tolist() == [0, 3]


def test_reduction_finds_the_asymmetric_unit():
    rng = np.random.default_rng(2)
    cell = cells.lattice_matrix(7.1, 8.3, 9.7, 90, 101, 90)
    asym, names = rng.random((4, 3)), np.array(["C", "N", "O", "C"])
    ops = [symmetry.parse(o) for o in GROUPS[1]]
    points, kinds = [], []
    for x, n in zip(asym, names):
        for r, t in ops:
            points.append((np.array(r) @ x + np.array([float(v) for v in t])) % 1)
            kinds.append(n)
    points, kinds = np.array(points), np.array(kinds)
    found = cells.find_operations(points, kinds, cell)
    assert len(found) == 4
    assert len(np.unique(cells.orbits(points, kinds, cell, found))) == 4


def test_nearest_neighbours_against_a_large_block():
    rng = np.random.default_rng(3)
    cell = cells.lattice_matrix(4.0, 6.5, 9.0, 75, 110, 95)
    motif = rng.random((3, 3)) @ cell
    found = pdd.nearest_neighbours(motif, cell, 20)
    grid = np.array(list(itertools.product(range(-7, 8), repeat=3))) @ cell
    cloud = (motif[None] + grid[:, None]).reshape(-1, 3)
    want = np.sort(np.linalg.norm(motif[:, None] - cloud[None], axis=2), axis=1)[:, 1:21]
    assert np.allclose(found, want)


def test_assignment_and_transport():
    rng = np.random.default_rng(4)
    for n in (1, 2, 5, 6):
        cost = rng.random((n, n))
        best = min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n)))
        assert np.isclose(cost[np.arange(n), pdd.assignment(cost)].sum(), best)
        assert np.isclose(pdd.transport(np.full(n, 1 / n), np.full(n, 1 / n), cost), best / n)
    for _ in range(20):  # unequal weights in twelfths against the assignment of single units
        a, b = (np.diff(np.sort(np.concatenate(([0, 12], rng.choice(np.arange(1, 12), k, replace=False))))) for k in (2, 3))
        cost = rng.random((3, 4))
        big = np.repeat(np.repeat(cost, a, axis=0), b, axis=1)
        want = big[np.arange(12), pdd.assignment(big)].sum() / 12
        assert np.isclose(pdd.transport(a / 12, b / 12, cost), want)
    with pytest.raises(ValueError):
        pdd.transport(np.array([0.5]), np.array([0.6]), np.ones((1, 1)))


def test_equal_crystals_have_distance_zero():
    rng = np.random.default_rng(5)
    cell = cells.lattice_matrix(6, 7, 8, 90, 97, 90)
    f = rng.random((5, 3))
    a = pdd.descriptor(f @ cell, list("CCHHO"), cell, 15)
    b = pdd.descriptor(((f + [0.3, 0.1, 0.7]) % 1) @ cell, list("CCHHO"), cell, 15)
    assert [r[0] for r in a] == [r[0] for r in b] and np.allclose([r[2] for r in a], [r[2] for r in b])
    assert np.isclose(sum(r[1] for r in a), 1)


def test_internal_coordinates_round_trip():
    rng = np.random.default_rng(6)
    points = np.cumsum(rng.normal(size=(7, 3)) + [0.8, 0, 0], axis=0)
    bonds = {(i, i + 1) for i in range(6)}
    rows, _ = zmatrix.generate(["C", "C", "O", "N", "C", "H", "H"], bonds, points)
    back = zmatrix.rebuild([(*r[1:], *[None] * (7 - len(r))) for r in rows])
    assert [r[0] for r in rows][-2:] == ["H", "H"]
    want = np.sort(np.linalg.norm(points[:, None] - points[None], axis=2).ravel())
    assert np.allclose(np.sort(np.linalg.norm(back[:, None] - back[None], axis=2).ravel()), want)


CIF = """data_x
_cell_length_a 5.0(2)
_cell_length_b 6
_cell_length_c 7
_cell_angle_alpha 90
_cell_angle_beta 95.5(1)
_cell_angle_gamma 90
_symmetry_space_group_name_H-M 'P -1'
loop_
_symmetry_equiv_pos_site_id
_symmetry_equiv_pos_as_xyz
1 x,y,z
2 -x,-y,-z
loop_
_atom_site_label
_atom_site_type_symbol
_atom_site_fract_x
_atom_site_fract_y
_atom_site_fract_z
_atom_site_occupancy
C1 C 0.1(1) 1/4
0.3 .
D1 D 0 0 0 0.5
O9 O 0.9
"""
POSCAR = "t\n2.0\n2 0 0\n0 3 0\n0 0 4\nC H\n1 2\nSelective\nDirect\n0 0 0 T T T\n.5 .5 .5\n.25 0 0\n"
RES = "TITL t\nCELL 0.71 5 6 7 90 95 90\nZERR 4 0 0 0 0 0 0\nLATT -1\nSYMM -x,1/2+y,-z\nSFAC C H\nUNIT 4 4\nC1 1 0.1 0.2 0.3 11.0\nH1 H 0.4 0.5 0.6\nEND\n"


def test_files(spark):
    from pyspark.sql import functions as F

    rows = [("/d/x.cif", CIF), ("/d/POSCAR", POSCAR), ("/d/t.res", RES), ("/d/bad.cif", "data_\n"), ("/d/what.xyz", "")]
    df = spark.createDataFrame(rows, "path string, text string")
    found = {r.name: r for r in st.parse_texts(df).collect()}
    x = found["x"]
    assert (x.a, x.beta, x.space_group, x.operations) == (5.0, 95.5, "P -1", ["x,y,z", "-x,-y,-z"])
    assert [(a.label, a.element, a.fx, a.fy, a.occupancy) for a in x.atoms] == [("C1", "C", 0.1, 0.25, None), ("D1", "H", 0.0, 0.0, 0.5)]
    assert [a.label for a in found["POSCAR"].atoms] == ["C1", "H1", "H2"] and found["POSCAR"].a == 4.0 and found["POSCAR"].explicit_cell
    assert found["t"].lattice_number == -1 and [a.element for a in found["t"].atoms] == ["C", "H"]
    assert found["bad"].error and found["what"].error
    full = st.parse_texts(df.where(F.col("path") == "/d/x.cif"), expanded=True)
    assert [r.label for r in st.atoms_of(full).collect()] == ["C1_1", "C1_2", "D1_1"]
    assert st.partial_occupancies(full).count() == 1


METHANOL = (["C", "O", "H", "H", "H", "H"], {(0, 1), (1, 2), (0, 3), (0, 4), (0, 5)}, np.array([[0, 0, 0], [1.42, 0, 0], [1.75, 0.9, 0], [-0.36, 1.03, 0], [-0.36, -0.5, 0.89], [-0.36, -0.5, -0.89]]))
BUTANE = (["C"] * 4, {(0, 1), (1, 2), (2, 3)}, np.array([[0, 0, 0], [1.53, 0, 0], [2.04, 1.44, 0], [3.57, 1.44, 0.2]]))


def kinds(elements, bonds, points):
    """Proper and improper dihedrals as sets of the atoms they turn about."""
    near = zmatrix.neighbours(len(elements), bonds)
    rows, warnings = zmatrix.references(elements, near, points)
    assert not warnings
    turns = [r for r in rows if r[3] is not None]
    return [set(r) for r in turns if r[3] in near[r[2]]], [r[0] for r in turns if r[3] in near[r[1]]]


def test_branches_turn_about_their_fork():
    assert kinds(*BUTANE) == ([{0, 1, 2, 3}], [])
    assert kinds(*METHANOL) == ([{0, 1, 2, 3}], [4, 5])


def test_straight_chain_warns():
    points = np.array([[0, 0, 0], [1.5, 0, 0], [3.0, 0, 0], [4.5, 0, 0]])
    assert "row 3: nearly straight angle" in zmatrix.references(["C"] * 4, zmatrix.neighbours(4, {(0, 1), (1, 2), (2, 3)}), points)[1]


def test_random_molecules_rebuild_and_match_their_shuffles():
    rng = np.random.default_rng(11)
    for n in rng.integers(1, 14, size=60):
        elements = list(rng.choice(list("CCNOH"), size=n))
        bonds = {(int(rng.integers(i)), i) for i in range(1, n)}
        if n > 3:
            bonds |= {tuple(sorted(int(k) for k in rng.choice(n, 2, replace=False)))}
        points = rng.normal(size=(n, 3)) * 2
        near = zmatrix.neighbours(n, bonds)
        template, _ = zmatrix.references(elements, near, points)
        order = [r[0] for r in template]
        assert sorted(order) == list(range(n))
        rows = zmatrix.numbered(template, elements, points)
        back = zmatrix.rebuild([(*r[1:], *[None] * (7 - len(r))) for r in rows])
        want = points[order]
        assert np.allclose(np.linalg.norm(want[:, None] - want[None], axis=2), np.linalg.norm(back[:, None] - back[None], axis=2), atol=1e-6)
        to = rng.permutation(n)
        mixed = [None] * n
        for i in range(n):
            mixed[to[i]] = elements[i]
        moved = {tuple(sorted((int(to[i]), int(to[j])))) for i, j in bonds}
        match = zmatrix.isomorphism(elements, near, mixed, zmatrix.neighbours(n, moved))
        assert [mixed[k] for k in match] == elements and {tuple(sorted((match[i], match[j]))) for i, j in bonds} == moved


def test_different_molecules_do_not_match():
    chain, star = zmatrix.neighbours(4, {(0, 1), (1, 2), (2, 3)}), zmatrix.neighbours(4, {(0, 1), (0, 2), (0, 3)})
    assert zmatrix.isomorphism(["C"] * 4, chain, ["C"] * 4, star) is None
    assert zmatrix.isomorphism(["C", "C", "C", "N"], chain, ["C", "N", "C", "C"], chain) is None
