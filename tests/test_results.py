"""Result tables: points, outliers, merges, pairings, reasons, counts, summaries and their files."""

import pytest
from pyspark.sql import functions as F

from crystalspark.operators import results
from crystalspark.sources import structures, tables, writers

XML = "<modeling><incar><i type='int' name=\"NELM\">60</i></incar><calculation><scstep><time name='total'>1 2</time></scstep><energy><i name='e_0_energy'> -1.5 </i></energy></calculation></modeling>"


def test_points_take_the_first_name_and_finite_numbers(spark):
    df = spark.createDataFrame([(" ", "a", "1.5", "2", "true"), ("b", "x", "", "2", "TRUE"), ("c", None, "nan", "2", None), ("d", None, "3", "4", "no")], "identifier string, name string, u string, v string, hydrate string")
    assert sorted(map(tuple, results.points(df, "u", "v").collect())) == [("a", 1.5, 2.0, True), ("d", 3.0, 4.0, False)]
    assert not any(r.is_hydrate for r in results.points(df, "u", "v", exact="True").collect())
    with pytest.raises(ValueError):
        results.points(df.drop("identifier", "name"), "u", "v")


def test_outliers_in_four_ways(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "identifier string, x int")
    sizes = {k: tuple(p.count() for p in results.outliers(df, ["a"], k)) for k in results.OUTLIERS}
    assert sizes == {"separate": (2, 1), "drop": (2, 0), "mark": (3, 0), "keep": (3, 0)}
    assert results.outliers(df, ["a"], "mark")[0].where("is_outlier").count() == 1


def test_merge_pair_and_reasons(spark):
    a, b = spark.createDataFrame([(1, "p", 7), (2, "q", None)], "id int, x string, z int"), spark.createDataFrame([(2, "r"), (3, None)], "id int, x string")
    assert sorted(map(tuple, results.merged(a, b, "id").collect())) == [(1, "p", 7, True, False), (2, "r", None, True, True), (3, None, None, False, True)]
    assert dict(map(tuple, results.paired(a, b, "id").collect())) == {1: "missing right", 2: "paired", 3: "missing left"}
    assert results.paired(a, a, "id", strict=True).count() == 2
    with pytest.raises(Exception, match="missing right 1"):
        results.paired(a, b, "id", strict=True).collect()
    rows = [("s1", "x", None, None, None, "p", "p"), ("s2", "-1", "n", None, None, "p", "p"), ("s3", "-1", " ", "c", "p", "p", "p"), ("s4", "-1", None, None, None, "p", "p"), ("s5", "-1", None, "c", None, "p", "p"), ("s6", "-1", None, "c", "p", "p", None), ("s7", "-1", None, "c", "p", "p", "p")]
    df = spark.createDataFrame(rows, "system string, energy string, notes string, contcar string, poscar string, signature string, expected_signature string")
    found = [r.reason for r in results.campaign_reasons(df, ["s3"]).orderBy("system").collect()]
    assert found == ["invalid energy", "notes present", "special positions", "no CONTCAR", "no POSCAR", "signature differs", "generated"]


def test_counts_lookups_and_reports(spark, tmp_path):
    df = spark.createDataFrame([("a", "ok"), ("b", "ok"), ("c", None)], "identifier string, status string")
    assert dict(map(tuple, results.status_counts(df, ["ok", "error"]).collect())) == {"ok": 2, "error": 0, "unknown": 1}
    assert {r.value: (r.n, round(r.share, 3)) for r in results.distribution(df, "status").collect()} == {"ok": (2, 0.667), None: (1, 0.333)}
    assert results.highlighted(df, df.where("status = 'ok'").union(df)).count() == 3
    files = spark.createDataFrame([("s", [], "POSCAR", "POSCAR", 3, "/r/s/POSCAR"), ("s", ["1"], "POSCAR", "1/POSCAR", 4, "/r/s/1/POSCAR")], "system string, chain array<string>, filename string, relative_path string, size_bytes long, path string")
    assert {r.system: r.start_path for r in results.with_start(spark.createDataFrame([("s",), ("t",)], "system string"), files).collect()} == {"s": "/r/s/POSCAR", "t": None}
    results.write_table(results.manifest_table(files), str(tmp_path / "m"))
    back = spark.read.option("header", True).csv(str(tmp_path / "m"))
    assert back.columns == ["system_name", "calculation_chain", "filename", "relative_path", "size_bytes", "absolute_path"]
    assert sorted(r.calculation_chain for r in back.collect()) == [".", "1"]
    assert results.markdown(df, ["identifier"], "T").head()[0] == "## T\n\n| identifier | status |\n|---|---|\n| a | ok |\n| b | ok |\n| c |  |"


def test_summary_orders_runs_by_depth_and_numbers(spark):
    rows = [("s", f"{p}vasprun.xml", t) for p, t in (("", XML), ("10/", XML), ("9/", XML), ("2/1/", "broken"), ("old/", XML))]
    found = results.system_summary(spark.createDataFrame(rows, "system string, relative_path string, text string")).orderBy("position").collect()
    assert [r.relative_path for r in found] == ["old/vasprun.xml", "vasprun.xml", "9/vasprun.xml", "10/vasprun.xml", "2/1/vasprun.xml"]
    assert [r.is_latest_calculation for r in found] == [False] * 4 + [True] and {r.calculation_count for r in found} == {5}
    assert found[0].chain_error and found[1].final_energy_ev == -1.5 and found[4].parse_error and found[4].final_energy_ev is None


def test_dispatch_by_format(spark):
    atoms = spark.createDataFrame([(1, 5.0, 6.0, 7.0, 90.0, 90.0, 90.0, 0, "C1", "C", 0.1, 0.2, 0.3)], "structure_id long, a double, b double, c double, alpha double, beta double, gamma double, atom_idx int, label string, element string, fx double, fy double, fz double")
    for name, reader in (("x.cif", structures.read_cif), ("RES", structures.read_res)):
        assert [a[1] for a in reader(writers.text_of(atoms, name).head().text)["atoms"]] == ["C"]
    with pytest.raises(ValueError):
        writers.text_of(atoms, "x.xyz")
    assert writers.text_of(atoms.withColumns({c: F.lit(1.0) for c in "xyz"}), "pdb").head().text.startswith("CRYST1")


def test_runs_of_a_folder_are_summed_up(spark, tmp_path):
    for folder in ("s/1/2", "s/1", "t", "."):
        (tmp_path / "root" / folder).mkdir(parents=True, exist_ok=True)
        (tmp_path / "root" / folder / "vasprun.xml").write_text(XML)
    (tmp_path / "root" / "s" / "OUTCAR").write_text("x")
    found = results.system_summary(results.runs(spark, str(tmp_path / "root"))).orderBy("system", "position").collect()
    assert [(r.system, r.relative_path, r.is_latest_calculation, r.final_energy_ev) for r in found] == [("s", "1/vasprun.xml", False, -1.5), ("s", "1/2/vasprun.xml", True, -1.5), ("t", "vasprun.xml", True, -1.5)]


def test_potentials_keep_all_values(spark):
    line = "C N " + " ".join(str(k) for k in range(30))
    rows = spark.createDataFrame([("p", i, x) for i, x in enumerate(["START PARAMS ! x", line, "END"])], "path string, line_no int, line string")
    found = tables.potentials(rows).collect()
    assert [(r.site_a, r.site_b, list(r["values"])) for r in found] == [("C", "N", [float(k) for k in range(30)])]
