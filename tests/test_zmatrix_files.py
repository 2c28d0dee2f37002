"""Numeric Z-matrix files: comments, row forms, labels, bonds and what is wrong with them."""

from crystalspark.sources import zmatrix_files as z

GOOD = "# ZMAT v1\n# title: water\n\n# bonds: 2-1 1-3 1-2\nO\nH 1 0.96 # inline\nHb h 1 0.97 2 104.5\n"


def read(spark, **texts):
    rows = [(f"/x/{k}.zmat", v) for k, v in texts.items()]
    return z.documents(spark.createDataFrame(rows, "path string, text string"))


def test_rows_labels_and_bonds(spark):
    found = read(spark, water=GOOD, plain="C\nC 1 1.5\n", named="# labels: a b\nC\nD X 1 1.1\n").cache()
    by = {r.mol_id: r for r in found.collect()}
    water = by["water"]
    assert water.title == "water" and by["plain"].title == "plain" and not water.errors
    assert [(a.row_index, a.line_no, a.label, a.element) for a in water.atoms] == [(1, 5, "O1", "O"), (2, 6, "H1", "H"), (3, 7, "Hb", "H")]
    assert (water.atoms[2].bond_to, water.atoms[2].bond_length, water.atoms[2].angle_to, water.atoms[2].angle_deg, water.atoms[2].dihedral_to) == (1, 0.97, 2, 104.5, None)
    assert [(b.i, b.j) for b in water.bonds] == [(1, 2), (1, 3)]
    assert [a.label for a in by["plain"].atoms] == ["C1", "C2"] and [(a.label, a.element) for a in by["named"].atoms] == [("a", "C"), ("X", "H")]
    assert z.atom_rows(found).count() == 7 and z.bond_rows(found).count() == 2


def test_errors_are_rows(spark):
    bad = {
        "none": "# title: x\n", "null": None, "count": "# labels: a\nC\nC 1 1.5\n", "twice": "# labels: a a\nC\nC 1 1.5\n", "field": "C\nC 1\n", "word": "C\nC 1 abc\n", "inf": "C\nC 1 inf\n",
        "late": "C\nC 2 1.5\n", "few": "C\nC\n", "short": "C\nC 1 -1.5\n", "odd": "Qq\n", "bond": "# bonds: 1-1 1:2 1-2\nC\nC 1 1.5\n",
    }
    found = {r.mol_id: r.errors for r in read(spark, **bad).collect()}
    assert found["none"] == found["null"] == ["no atom rows"]
    assert found["count"] == ["labels and rows differ in number"] and found["twice"] == ["labels are not unique"]
    assert found["word"] == found["inf"] == ["line 2: reference or value is no number"]
    assert found["late"] == ["line 2: reference to no earlier row"] and found["few"] == ["line 2: wrong number of references"] and found["short"] == ["line 2: length not positive"]
    assert found["odd"] == ["line 1: no element"] and found["bond"] == ["line 1: no bond 1-1", "line 1: no bond 1:2"]
    assert len(found["field"]) == 1


def test_molecules_take_the_first_matrix_with_their_labels(spark):
    atoms = spark.createDataFrame([(1, 0, 5, "C1"), (1, 0, 6, "O1"), (1, 9, 9, "N1")], "structure_id long, component int, atom_idx int, label string")
    rows = spark.createDataFrame([("b", 1, "C1"), ("b", 2, "O1"), ("a", 1, "O1"), ("a", 2, "C1"), ("c", 1, "C1")], "mol_id string, row_index int, label string")
    found = sorted(map(tuple, z.matched(atoms, rows).collect()), key=str)
    assert found == [(1, 0, "a", 1, 6), (1, 0, "a", 2, 5), (1, 9, None, None, None)]


def test_the_condition_on_errors_is_no_filter(spark):
    """A filter on the errors is pushed below the steps that make them, and each step is then worked out as often as the next ones name it."""
    found = z.documents(spark.createDataFrame([("/x/water.zmat", GOOD), ("/x/bad.zmat", "Qq\n")], "path string, text string"))
    for rows in (z.atom_rows(found), z.bond_rows(found)):
        assert {r.mol_id for r in rows.collect()} == {"water"}
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_replace") < 10, plan[:2000]
