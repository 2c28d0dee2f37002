from fractions import Fraction

import numpy as np
import pytest

from crystalspark.operators import cells, corpus, groups, lattices, symmetry

PARAMETERS = {2: (5, 6, 7, 80, 95, 103), 15: (5, 6, 7, 90, 100, 90), 74: (5, 6, 7, 90, 90, 90), 142: (5, 5, 7, 90, 90, 90), 194: (5, 5, 7, 90, 90, 120), 230: (6, 6, 6, 90, 90, 90)}


def shear(rng, times=4):
    p = np.eye(3, dtype=int)
    for _ in range(times):
        i, j = rng.choice(3, 2, replace=False)
        step = np.eye(3, dtype=int)
        step[i, j] = rng.integers(-2, 3)
        p = step @ p
    return p


def cell_of(number):
    return cells.lattice_matrix(*map(float, next(v for k, v in PARAMETERS.items() if number <= k)))


def full_of(name):
    letter, operations = groups.hall(name)
    return [(r, (t + c) / 24) for r, t in operations for c in groups.CENTRINGS[letter]]


@pytest.mark.parametrize("cell,order", [
    (np.eye(3) * 5, 48), (np.array([[0, 3, 3], [3, 0, 3], [3, 3, 0.0]]), 48), (np.array([[-3, 3, 3], [3, -3, 3], [3, 3, -3.0]]), 48), (cell_of(194), 24),
    (cell_of(142), 16), (cell_of(74), 8), (cell_of(15), 4), (cell_of(2), 2), (np.array([[1, 0, 3], [-0.5, 3**0.5 / 2, 3], [-0.5, -(3**0.5) / 2, 3]]), 12),
])
def test_a_lattice_has_its_symmetry_in_any_basis(cell, order):
    rng = np.random.default_rng(order)
    lengths = set()
    for _ in range(40):
        given = shear(rng, 6) @ cell
        p, small = lattices.reduced(given)
        assert np.allclose(p @ given, small) and round(np.linalg.det(p)) == 1
        assert len(lattices.rotations(small, 1e-3)) == order
        lengths.add(tuple(np.round(np.sort(np.linalg.norm(small, axis=1)), 6)))
    assert len(lengths) == 1


def test_every_tabled_group_is_closed_and_named_only_as_itself_in_any_basis_and_origin():
    rng = np.random.default_rng(1)
    for number, symbol, name, *_ in groups.rows_of():
        letter, operations = groups.hall(name)
        table = {groups._key(r): t for r, t in operations}
        for r, t in operations:
            for q, s in operations:
                gap = r @ s + t - table[groups._key(r @ q)]
                assert any(((gap - c) % 24 == 0).all() for c in np.array(groups.CENTRINGS[letter])), name
        p, x = shear(rng), rng.random(3)
        to = np.linalg.inv(p.T)
        moved = [(np.rint(to @ r @ p.T).astype(int), (to @ (t + r @ x - x)) % 1) for r, t in full_of(name)]
        assert groups.identify([moved[k] for k in rng.permutation(len(moved))]) == (number, symbol)


def test_listed_settings_fill_their_places():
    places = sorted(k for found in groups.settings().values() for k, _, _ in found)
    assert len(places) == len(set(places))
    rows = groups.rows_of()
    for (number, _, name, first, origins), (_, _, _, after, more) in zip(rows, rows[1:]):
        if 3 <= number <= 73 and origins == more == 1:
            assert [k for k in places if first <= k < after] == list(range(first, after)), name


def test_operations_and_orbits_of_cells_in_any_basis():
    rng = np.random.default_rng(2)
    for number, symbol, name, *_ in groups.rows_of():
        if number > 74 and number % 5:
            continue
        full, general = full_of(name), rng.random((2, 3))
        points = np.array([x @ r.T + t for x in general for r, t in full])
        elements, p, origin = np.repeat(["C", "N"], len(full)), shear(rng), rng.random(3)
        given, f = p @ cell_of(number), (points - origin) @ lattices.inverse(p)
        found = cells.find_operations(f, elements, given, 1e-3)
        assert len(found) == len(full), symbol
        assert groups.identify([(r.T, t) for r, t in found], 1e-3) == (number, symbol)
        label = cells.orbits(f, elements, given, found, 1e-3)
        assert sorted(set(label.tolist())) == [0, len(full)]


def test_names_and_settings_of_written_operations():
    assert groups.name_operations(corpus.GROUPS[1]) == (14, "P 21/c", 81)
    assert groups.name_operations(["x,y,z", "1/2-x,1/2+y,1/2-z", "-x,-y,-z", "1/2+x,1/2-y,1/2+z"]) == (14, "P 21/c", 82)
    assert groups.name_operations(["x,y,z", "-x,1/2+y,-z", "-x,-y,-z", "x,1/2-y,z"]) == (11, "P 21/m", 60)
    assert groups.name_operations(["x,y,z", "-x,-y,z", "x,-y,z"]) == (None, None, None)  # no group
    assert groups.name_operations(["x,y,z", "x+1/2,y,z", "x,y+1/2,z", "x+1/2,y+1/2,z"])[0] == 1


def test_rewritten_operations_keep_their_name():
    rng = np.random.default_rng(3)
    for sg, number in ((0, 2), (1, 14), (2, 19), (3, 15)):
        for _ in range(5):
            p, shift = shear(rng), tuple(Fraction(int(x), 8) for x in rng.integers(0, 8, 3))
            moved = [groups.rebased(op, p, shift) for op in corpus.GROUPS[sg]]
            assert groups.name_operations(moved)[0] == number


def test_records_expand_back_in_every_setting_with_a_lattice_number():
    for _, symbol, name, *_ in groups.rows_of():
        texts = [symmetry.written((groups._key(r), tuple(Fraction(int(x)) / 24 for x in np.rint(24 * t).astype(int)))) for r, t in full_of(name)]
        lattice, records = groups.records_of(texts)
        assert lattice is not None, symbol
        back = {(r, symmetry.twentyfourths((r, t))) for r, t in symmetry.full_operations(records, lattice)}
        assert back == {(x[0], symmetry.twentyfourths(x)) for x in map(symmetry.parse, texts)}, symbol


def test_frames(spark):
    rows = [("a", op) for op in corpus.GROUPS[3]] + [("b", "x,y,z"), ("c", "nonsense"), ("d", "x,y,z"), ("d", "-x,-y,z"), ("d", "x,-y,z")]
    found = {r.structure_id: r for r in groups.with_names(spark.createDataFrame(rows, "structure_id string, op string")).collect()}
    assert (found["a"].number, found["a"].hall, found["a"].lattice, len(found["a"].records)) == (15, 90, 7, 1)
    assert found["b"].symbol == "P 1" and found["c"].number is None and found["d"].number is None
    atoms = [("s", k, "C", *f, 5.0, 6.0, 7.0, 80.0, 95.0, 103.0) for k, f in enumerate([(0.1, 0.2, 0.3), (0.9, 0.8, 0.7), (0.4, 0.15, 0.77), (0.6, 0.85, 0.23)])]
    frame = spark.createDataFrame(atoms, "structure_id string, atom_idx int, element string, fx double, fy double, fz double, a double, b double, c double, alpha double, beta double, gamma double")
    one = cells.named_cells(frame).collect()[0]
    assert (one.n_operations, one.n_unique, one.number, one.symbol) == (2, 2, 2, "P -1")


def test_a_centring_that_a_rotation_takes_elsewhere_is_no_group():
    turn = np.array(groups.ABOUT_Z[4])
    half = [np.zeros(3), np.array([0.5, 0, 0])]
    assert groups.identify([(np.linalg.matrix_power(turn, k), t) for k in range(4) for t in half]) is None
    gap = [np.zeros(3), np.array([0.5, 0, 0]), np.array([0, 0.5, 0])]  # the sum of the two is missing
    assert groups.identify([(np.eye(3, dtype=int), t) for t in gap]) is None
    both = [np.zeros(3), np.array([0.5, 0.5, 0])]
    assert groups.identify([(np.linalg.matrix_power(turn, k), t) for k in range(4) for t in both]) == (75, "P 4")
