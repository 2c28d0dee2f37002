"""Many cells at once give what each gives alone, and naming is worked out once for equal sets of rotations."""

import numpy as np
import pytest

from crystalspark.operators import batches, cells, groups

OPERATIONS = [(np.eye(3, dtype=int), np.zeros(3)), (np.diag([-1, 1, -1]), np.array([0, 0.5, 0.5])), (-np.eye(3, dtype=int), np.zeros(3)), (np.diag([1, -1, 1]), np.array([0, 0.5, 0.5]))]


def many(count=60):
    """Flat arrays of cells in sheared bases: special positions, centrings, cubes, and sites on top of each other."""
    rng, points, elements, offsets, lattices = np.random.default_rng(3), [], [], [0], []
    for s in range(count):
        cell = np.eye(3) * 6 if s % 5 == 0 else cells.lattice_matrix(5 + s % 3, 6 + s % 2, 7, 90, 90 + s % 20 * (s % 4 > 0), 90)
        f = rng.random((rng.integers(1, 5), 3))
        f = np.round(f * 4) / 4 if s % 7 == 0 else f * ([0] + [1] * (len(f) - 1) if s % 3 == 0 else [1] * len(f))[0] if s % 3 == 0 else f
        kinds, ops = rng.choice(["C", "H", "O"], len(f)), OPERATIONS if s % 4 else OPERATIONS[:2]
        g, kinds = np.concatenate([f @ r.T + t for r, t in ops]), np.tile(kinds, len(ops))
        if s % 11 == 0:
            g, kinds = np.concatenate([g, g + [0.5, 0.5, 0]]), np.tile(kinds, 2)
        if s % 13:
            keep = cells.greedy_sites(g, kinds, cell)
            g, kinds = g[keep], kinds[keep]
        m = np.array([[1, 0, 0], [s % 3 - 1, 1, 0], [s % 5 - 2, s % 4 - 1, 1]])
        points.append(g @ np.linalg.inv(m))
        elements.append(kinds)
        offsets.append(offsets[-1] + len(g))
        lattices.append(m @ cell)
    return points, elements, np.array(offsets), np.array(lattices)


@pytest.mark.parametrize("block", [50, 2_000_000])
def test_batches_agree_with_single_cells(monkeypatch, block):
    monkeypatch.setattr(batches.blocks, "__defaults__", (block,))
    points, elements, offsets, given = many()
    flat = np.concatenate(points), np.concatenate(elements), offsets, given
    found, kept = batches.Symmetry(*flat), batches.greedy(*flat, 0.3)
    rotations, shifts = found.given()
    first = np.cumsum(found.count) - found.count
    for s, (p, e) in enumerate(zip(points, elements)):
        operations, label = cells.analysed(p, e, given[s])
        mine = slice(first[s], first[s] + found.count[s])
        assert len(operations) == found.count[s] and (label == found.label[offsets[s] : offsets[s + 1]]).all()
        for (r, t), r2, t2 in zip(operations, rotations[mine], shifts[mine]):
            assert (r == r2).all() and np.allclose(t, t2, atol=1e-9)
        assert np.flatnonzero(kept[offsets[s] : offsets[s + 1]]).tolist() == cells.greedy_sites(p, e, given[s], 0.3).tolist()


def test_names_of_equal_rotations_share_one_plan():
    groups._ways.cache_clear()
    for shift in (0.0, 0.1, 0.37):  # the same group with its origin elsewhere along b
        operations = [(r, t + (np.eye(3) - r) @ np.array([0, shift, 0])) for r, t in OPERATIONS]
        assert groups.identify(operations) == (14, "P 21/c")
    assert groups._ways.cache_info().misses == 1


def test_pairs_that_carry_their_atoms_give_the_distances_of_described_pairs(spark, monkeypatch):
    """Steps of a few atoms, a structure named twice, and other compositions; no list of distances is shuffled."""
    from pyspark.sql import functions as F

    from crystalspark.operators import compare, pdd

    monkeypatch.setattr(pdd, "STEP", 60)
    points, elements, offsets, given = many(12)
    rows = [(s, 6.0, 6.5, 7.0, 90.0, 95.0, 90.0, i, str(e), *map(float, p)) for s in range(12) for i, (p, e) in enumerate(zip(points[s], elements[s]))]
    atoms = compare.placed(spark.createDataFrame(rows, "structure_id long, a double, b double, c double, alpha double, beta double, gamma double, atom_idx int, element string, fx double, fy double, fz double"))
    pairs = spark.createDataFrame([(s, (s + k) % 12) for s in range(12) for k in (0, 1, 5)], "left_id long, right_id long")
    want = {(r.left_id, r.right_id, r.element): r.distance for r in pdd.distances(pairs, pdd.descriptors(atoms, 6)).collect()}
    df = pdd.compared(pdd.with_points(pairs, atoms), 6)
    got = {(r.left_id, r.right_id, r.element): r.distance for r in df.collect()}
    assert got.keys() == want.keys()
    for key, d in want.items():
        assert got[key] == (None if d is None else pytest.approx(d, abs=1e-12))
    assert "distances" not in df._jdf.queryExecution().executedPlan().toString()
    moved = atoms.withColumns({"fx": F.col("fx") + 0.001, "fz": F.col("fz") + 1.0})
    assert {r.structure_id: r.n for r in pdd.site_matching(atoms, moved).collect()} == {s: len(p) for s, p in enumerate(points)}
