"""Steps that take a structure or molecule as one row: the same values as row by row, and few joins."""

import numpy as np

from crystalspark.operators import bonds, pdd, reports, zmatrix

NAMES = "mol_id string, row_index int, element string, bond_to int, bond_length double, angle_to int, angle_deg double, dihedral_to int, dihedral_deg double"


def random_rows(n, seed):
    r = np.random.default_rng(seed)
    out = []
    for i in range(n):
        refs = r.permutation(i)[:3] + 1
        row = [(int(x), v) for x, v in zip(refs, (r.uniform(0.9, 1.9), r.uniform(40, 170), r.uniform(-180, 180)))]
        out.append(tuple(x for pair in row + [(None, None)] * (3 - len(row)) for x in pair))
    return out


def joins(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return sum(line.lstrip(" :+-").startswith("Join") for line in plan.splitlines())


def test_molecules_are_rebuilt_together():
    molecules = [random_rows(n, n) for n in (1, 7, 2, 3, 30, 4, 0, 7)]
    offsets = np.cumsum([0] + [len(m) for m in molecules])
    flat = [r for m in molecules for r in m]
    refs = np.array([[r[k] or 0 for k in (0, 2, 4)] for r in flat])
    values = np.array([[np.nan if r[k] is None else r[k] for k in (1, 3, 5)] for r in flat])
    want = np.concatenate([zmatrix.rebuild(m) for m in molecules])
    assert np.allclose(zmatrix.rebuild_many(offsets, refs, values), want, rtol=0, atol=1e-9)


def test_rows_and_points_meet_once(spark):
    rows = [(f"m{n}", i + 1, "C", b, r, a, t, d, f) for n in (4, 9) for i, (b, r, a, t, d, f) in enumerate(random_rows(n, n))]
    df = spark.createDataFrame(rows, NAMES)
    points = zmatrix.cartesian(df)
    m = zmatrix.measured(df, points)
    assert joins(m) <= 1  # a join for each kind of reference before
    found = {(x.mol_id, x.row_index): x for x in m.collect()}
    assert len(found) == len(rows)
    for mol, i, _, b, r, a, t, d, f in rows:
        x = found[mol, i]
        for want, got in ((r, x.bond_length), (t, x.angle_deg), (f, x.dihedral_deg)):
            assert got is None if want is None else abs(got - want) < 1e-5
    assert joins(reports.geometry_warnings(df, points)) <= 1
    gaps = points.where("NOT (mol_id = 'm9' AND row_index = 2)")  # lookups go by row_index where rows are missing
    lost = {(x.mol_id, x.row_index): x.bond_length for x in zmatrix.measured(df, gaps).collect()}
    for mol, i, _, b, r, *_ in rows:
        gone = mol == "m9" and 2 in (i, b)
        assert lost[mol, i] is None if gone or b is None else abs(lost[mol, i] - r) < 1e-5


def test_rows_of_many_structures_are_sorted_together():
    r = np.random.default_rng(5)
    near, names = np.sort(r.uniform(1, 9, (40, 6, 5)), axis=2), r.choice(["C", "H", "O"], (40, 6))
    near[3, 1], near[3, 4] = near[3, 0], near[3, 0] + 5e-5  # merge where their elements agree
    near[5:9, 2, :3] = near[5:9, 3, :3]  # tied at first, apart further on
    names[3] = names[5:9, 2:4] = "C"
    codes = np.unique(names, return_inverse=True)[1].reshape(names.shape)
    for tolerance, typed in ((1e-4, True), (None, True), (1e-4, False)):
        order, plain = pdd.separate(near, codes if typed else np.zeros_like(codes), tolerance)
        assert plain.sum() == (40 if tolerance is None else 39) and plain[3] == (tolerance is None)
        for s in np.flatnonzero(plain):
            want = pdd.described(near[s], names[s].tolist(), tolerance, typed)
            rows = order[s] - 6 * s
            assert [x[0] for x in want] == names[s][rows].tolist()
            assert np.allclose([x[2] for x in want], near[s][rows], rtol=0, atol=1e-12)


def test_pairs_of_one_key_are_many_rows(spark):
    r = np.random.default_rng(2)
    rows = [(i, i % 2, [float(x) for x in r.uniform(-1, 1, 5)]) for i in range(40)]
    rows += [(40, 0, [0.5, None, 9.0]), (41, 0, None), (42, 0, [None]), (43, None, [1.0])]
    found = pdd.largest_differences(spark.createDataFrame(rows, "vec_id long, label int, v array<double>"), "label", part=4)
    shuffled = found._jdf.queryExecution().optimizedPlan().toString()
    assert "_r" in next(line for line in shuffled.splitlines() if "Join" in line)  # by block, not by the label alone
    want = {}
    for a, k, v in rows:
        for b, m, w in rows:
            if a < b and k == m and k is not None and v and w:
                d = [abs(x - y) for x, y in zip(v, w) if x is not None and y is not None]
                want[a, b] = (k, max(d) if d else None)
    assert {(x.left_id, x.right_id): (x.label, x.distance) for x in found.collect()} == want


def test_equal_molecules_are_signed_once():
    bonds.signed.cache_clear()
    names = {bonds.signed(("H", "O", "H"), ((0, 1), (1, 2))) for _ in range(5)}
    assert names == {bonds.refined(["H", "O", "H"], [(0, 1), (1, 2)])} and bonds.signed.cache_info().misses == 1


def test_blocks_of_vectors_are_shuffled_once_not_once_a_partner(spark):
    rows = [(i, 0, [float(i), 1.0]) for i in range(400)]
    frame = spark.createDataFrame(rows, "vec_id long, label int, v array<double>")
    found = pdd.largest_differences(frame, "label", part=10)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "vs#" not in plan and "collect_list" not in plan  # what travels for the pairs names the blocks
    got = {(r.left_id, r.right_id): r.distance for r in found.collect()}
    assert len(got) == 400 * 399 // 2 and all(d == j - i for (i, j), d in got.items())
