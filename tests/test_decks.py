"""Decks, job folders and readers on small files."""

import os
import tarfile

from pyspark.sql import functions as F

from crystalspark.operators import calculations, reports
from crystalspark.sources import decks, tables
from crystalspark.sources import structures as st

CIF = """data_x
_cell_length_a 5
_cell_length_b 6
_cell_length_c 7
_cell_angle_alpha 90
_cell_angle_beta 90
_cell_angle_gamma 90
loop_
_atom_site_label
_atom_site_fract_x
_atom_site_fract_y
_atom_site_fract_z
C1 0.1 0.2 0.3
"""
ROWS = "mol_id string, row_index int, element string, bond_to int, bond_length double, angle_to int, angle_deg double, dihedral_to int, dihedral_deg double"


def test_a_file_is_one_structure_however_many_lines(spark, tmp_path):
    for name in ("a.cif", "b.cif"):
        (tmp_path / name).write_text(CIF)
    found = st.read_structures(spark, str(tmp_path)).collect()
    assert sorted(r.name for r in found) == ["a", "b"] and all(r.error is None and len(r.atoms) == 1 for r in found)
    assert tables.lines(spark, str(tmp_path)).where("line LIKE 'C1%'").select("line_no").distinct().collect()[0][0] == 12


def test_gaussian_rows_and_missing_values(spark):
    rows = [("a", 1, "C", *[None] * 6), ("a", 2, "O", 1, 1.4, *[None] * 4), ("a", 3, "H", 2, 0.96, 1, 109.5, None, None), ("b", 1, "C", *[None] * 6), ("b", 2, "O", 1, *[None] * 5)]
    found = {r.mol_id: r for r in decks.gaussian(spark.createDataFrame(rows, ROWS), ["mol_id"], decks.GaussianDeck(pop="None", pcm_eps=None)).collect()}
    lines = found["a"].text.split("\n")
    assert lines[3] == "#P PBE1PBE/6-311G(d,p) int=(ultrafine) nosymm opt=(Z-matrix, CalcAll,MaxCycle=150,MaxStep=20) scf=(QC)"
    assert lines[8:] == ["C", "O 1 bnd2", "H 2 bnd3 1 ang3", "", "Variables:", "bnd2=1.400000", "bnd3=0.960000", "ang3=109.500000", "Constants:", "", ""]
    assert found["b"].text is None and found["b"].error == "missing definition at row 2"


def test_scripts(spark):
    one = spark.range(1)
    made = one.select(decks.gaussian_script("#PBS -lwalltime=1\n#PBS -J 1-9\nname=SYSTEM_NAME\nformchk -3 x y\n\n", F.lit("job"))).head()[0]
    assert made == "#PBS -lwalltime=6:00:00\n#PBS -J 1-2\nname=job\nformchk -3 hess.chk hess.fchk\n"
    made = one.select(decks.flexible_script('#PBS -l walltime=1\nrun SYSTEM_NAME DOF > log\nb "x" DOF 2>&1', F.lit("s"), "/w", "9:00", use_dof=False)).head()[0]
    assert made == '#PBS -l walltime=9:00\nrun s > log\nb "x" 2>&1'
    assert one.select(decks.rigid_input("  RD filename: old\nTITLE DUMMEY_SYSTEM_NAME", F.lit("s"), "new.inter")).head()[0] == "  RD filename: new.inter\nTITLE s"


def test_bundles_are_whole_folders(spark, tmp_path):
    texts = spark.createDataFrame([(1, "x"), (2, None), (3, "")], "structure_id int, text string")
    files = decks.bundle(POSCAR=texts, run__sh=texts)
    decks.write_bundle(files, str(tmp_path / "jobs"))
    decks.write_bundle(files, str(tmp_path / "jobs"))
    assert sorted(os.listdir(tmp_path / "jobs")) == ["1", "3"] and sorted(os.listdir(tmp_path / "jobs" / "1")) == ["POSCAR", "run.sh"]
    assert os.access(tmp_path / "jobs" / "1" / "run.sh", os.X_OK)
    entries = spark.createDataFrame([(str(tmp_path / "jobs/1/POSCAR"), "1/POSCAR")], "path string, relative_path string")
    target = decks.archive(entries, str(tmp_path / "out" / "a.tar.gz"))
    assert not target.exists()
    with tarfile.open(decks.archive(entries, str(target), apply=True)) as done:
        assert done.getnames() == ["1/POSCAR"]


def test_calculation_xml_cut_short_or_empty(spark):
    whole = '<modeling><calculation><scstep/><scstep/><energy><i name="e_0_energy"> -3.5 </i></energy></calculation></modeling>'
    df = spark.createDataFrame([(1, whole), (2, whole[:40]), (3, ""), (4, None), (5, "<modeling></modeling>")], "id int, xml string")
    found = {r.id: r for r in df.withColumns(calculations.calculation_xml(F.col("xml"))).collect()}
    assert (found[1].ionic_iterations, found[1].total_electronic_iterations, found[1].final_energy_ev, found[1].converged) == (1, 2, -3.5, True)
    assert found[2].parse_error and found[3].parse_error and found[2].ionic_iterations is None
    assert found[4].parse_error is None and found[4].ionic_iterations is None
    assert found[5].ionic_iterations == 0 and found[5].final_energy_ev is None


def test_report_helpers(spark):
    name = spark.createDataFrame([("A_B_3_CONTCAR.cif",)], "n string")
    assert tuple(name.select(*reports.system_of_stage(F.col("n"))).head()) == ("A_B", "3")
    flat = reports.axis_limits(spark.createDataFrame([(2.0,), (2.0,)], "x double"), "x").head()
    assert tuple(flat) == (1.0, 3.0)
