"""Queries for decks, logs and reports, each beside its SQL where SQL can express it; they join those of ``catalog``."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from crystalspark.operators import bonds, calculations, compare, corpus, dims, pdd, reports, results, symmetry, zmatrix
from crystalspark.operators.corpus import table
from crystalspark.operators.store import written
from crystalspark.plans.catalog import _CHAIN, _MOLS, _SIGN, ELEMENTS_SQL, W_, cart, chain, found, ops, query, r6, rs, zrows
from crystalspark.sources import decks, writers, zmatrix_files

# decks

_Z = """zr AS (SELECT CAST(structure_id AS VARCHAR) AS mol_id, atom_idx + 1 AS n, element, label, atom_idx AS k, 1.0 + fx AS r, 60.0 + 100.0 * fy AS a, 360.0 * fz - 180.0 AS d FROM cells)"""
_COM = "%chk=hess.chk\n%mem=32000MB\n%nprocshared=8\n#P PBE1PBE/6-311G(d,p) int=(ultrafine) nosymm opt=(Z-matrix, CalcAll,MaxCycle=150,MaxStep=20) pop=(hlygat) scf=(QC) scrf=(PCM,Read)\n\nGas-phase optimization from crystal\n\n0 1\n"


@query(f"""{W_}, {_Z}, v AS (SELECT mol_id, string_agg(element || CASE WHEN k >= 1 THEN ' ' || k || ' bnd' || n ELSE '' END || CASE WHEN k >= 2 THEN ' ' || (k - 1) || ' ang' || n ELSE '' END || CASE WHEN k >= 3 THEN ' ' || (k - 2) || ' dih' || n ELSE '' END, chr(10) ORDER BY n) AS atoms,
string_agg('bnd' || n || '=' || printf('%.6f', r) || CASE WHEN k >= 2 THEN chr(10) || 'ang' || n || '=' || printf('%.6f', a) ELSE '' END || CASE WHEN k >= 3 THEN chr(10) || 'dih' || n || '=' || printf('%.6f', d) ELSE '' END, chr(10) ORDER BY n) FILTER (WHERE k >= 1) AS numbers FROM zr GROUP BY mol_id)
SELECT mol_id, '{_COM}' || atoms || chr(10) || chr(10) || 'Variables:' || coalesce(chr(10) || numbers, '') || chr(10) || 'Constants:' || chr(10) || 'EPS=11.0' || chr(10) || chr(10) AS text FROM v""")
def gaussian_deck(spark, sf_dir):
    return decks.gaussian(zrows(spark, sf_dir), ["mol_id"]).select("mol_id", "text")


@query(f"""{W_}, {_Z} SELECT mol_id, '# ZMAT v1' || chr(10) || '# title: m' || mol_id || chr(10) || '# bonds: ' || coalesce(string_agg(k || '-' || n, ' ' ORDER BY n) FILTER (WHERE k >= 1), '') || chr(10)
|| coalesce(string_agg('# torsion ' || (k - 3) || ': ' || n || '-' || (k - 2) || '-' || (k - 1) || '-' || k || ' bond ' || n || '-' || k || chr(10), '' ORDER BY n) FILTER (WHERE k >= 3), '')
|| string_agg(element || CASE WHEN k >= 1 THEN ' ' || k || ' ' || printf('%.10f', r) ELSE '' END || CASE WHEN k >= 2 THEN ' ' || (k - 1) || ' ' || printf('%.10f', a) ELSE '' END || CASE WHEN k >= 3 THEN ' ' || (k - 2) || ' ' || printf('%.10f', d) ELSE '' END || chr(10), '' ORDER BY n) AS text FROM zr GROUP BY mol_id""")
def zmatrix_deck(spark, sf_dir):
    return decks.zmatrix_text(zrows(spark, sf_dir), ["mol_id"], F.concat(F.lit("m"), "mol_id"))


@query(f"""{W_}, n AS (SELECT *, lag(label, 1) OVER w AS l1, lag(label, 2) OVER w AS l2, lag(label, 3) OVER w AS l3 FROM cells WINDOW w AS (PARTITION BY structure_id ORDER BY atom_idx))
SELECT structure_id, 'Z-matrix for molecule 1' || chr(10) || string_agg(concat_ws('    ', label, l1, l2, l3), chr(10) ORDER BY atom_idx) || chr(10) AS text FROM n GROUP BY structure_id""")
def flexible_zmatrix_deck(spark, sf_dir):
    labels = corpus.atoms(spark, sf_dir).select("structure_id", F.col("structure_id").cast("string").alias("mol_id"), (F.col("atom_idx") + 1).alias("row_index"), "label", F.lit(1).alias("molecule"))
    rows = zrows(spark, sf_dir).join(labels, ["mol_id", "row_index"])
    return decks.flexible_zmatrix(rows)


_EACH = lambda name, v: f"'{name} ' || string_agg('{v}', ' ') || chr(10)"


@query(f"""{W_}, {_MOLS} SELECT structure_id, 'Num_Mols_Asm ' || count(*) || chr(10) || 'Num_Atoms ' || string_agg(CAST(n_atoms AS VARCHAR), ' ' ORDER BY round(weight, 6) DESC, component) || chr(10) || 'exp_Ulatt -100.0' || chr(10) || 'Pressure 0.0' || chr(10)
|| {_EACH('scal_disp', '1.0')} || {_EACH('scal_elec', '1.0')} || {_EACH('Charges', '0')} || {_EACH('Multiplicity', '1')} AS text FROM mols GROUP BY structure_id""")
def rigid_info_deck(spark, sf_dir):
    return decks.rigid_info(found(spark, sf_dir, "molecules").select("structure_id", F.inline("molecules")), exp_ulatt=-100.0)


_UNIQUE = f"{_SIGN}, mt AS (SELECT structure_id, component, CAST(count(*) AS BIGINT) AS n_atoms FROM parts GROUP BY ALL), mf AS (SELECT structure_id, component, string_agg(element || n, '' ORDER BY element) AS formula FROM (SELECT structure_id, component, element, count(*) AS n FROM parts JOIN atoms USING (structure_id, atom_idx) GROUP BY ALL) GROUP BY ALL), un AS (SELECT structure_id, signature, min(component) AS component, count(*) AS copies FROM sg_ GROUP BY ALL), uq AS (SELECT * FROM un JOIN mt USING (structure_id, component) JOIN mf USING (structure_id, component))"


def unique(spark, sf_dir):
    both = written(found(spark, sf_dir, "atoms", "links", "molecules"), "molecules")
    return both.select("structure_id", F.inline("molecules")), bonds.signed_rows(both)


@query(f"""{W_}, {_UNIQUE} SELECT structure_id, CAST(row_number() OVER (PARTITION BY structure_id ORDER BY component) AS INT) AS index, CASE WHEN formula = 'H2O1' THEN 'WATER' ELSE CAST(structure_id AS VARCHAR) END AS molecule_name, n_atoms,
CASE WHEN formula = 'H2O1' THEN -76.3688745965::DOUBLE ELSE -100.5::DOUBLE END AS energy, '/jobs/intra_lam_global_' || row_number() OVER (PARTITION BY structure_id ORDER BY component) AS global_intra FROM uq""")
def flexible_molecules(spark, sf_dir):
    m, s = unique(spark, sf_dir)
    uniques = m.join(bonds.unique_molecules(s).withColumnRenamed("representative", "component"), ["structure_id", "component"]).withColumnRenamed("component", "representative")
    d = decks.flexible_molecules(uniques, F.col("structure_id").cast("string"), F.lit(-100.5), "/jobs")
    return d.select("structure_id", "index", "molecule_name", "n_atoms", "energy", "global_intra")


@query()
def flexible_input_deck(spark, sf_dir):
    m, s = unique(spark, sf_dir)
    uniques = m.join(bonds.unique_molecules(s).withColumnRenamed("representative", "component"), ["structure_id", "component"]).withColumnRenamed("component", "representative")
    return decks.flexible_input(decks.flexible_molecules(uniques, F.col("structure_id").cast("string"), F.lit(-100.5), "/jobs"))


@query(f"""{W_}, f AS (SELECT structure_id, element, min(atom_idx) AS first FROM atoms GROUP BY ALL)
SELECT structure_id, CASE WHEN count(*) FILTER (WHERE element = 'S') = 0 THEN string_agg('PAW ' || element || chr(10), '' ORDER BY first) END AS text, CASE WHEN count(*) FILTER (WHERE element = 'S') = 0 THEN '' ELSE 'S' END AS missing FROM f GROUP BY structure_id""")
def potcar_deck(spark, sf_dir):
    potentials = spark.createDataFrame([(e, f"PAW {e}\n") for e in corpus.SYMBOL_ELEMENTS if e != "S"], "element string, potential string")
    return decks.potcar(corpus.atoms(spark, sf_dir), potentials).select("structure_id", "text", F.array_join("missing", ",").alias("missing"))


@query()
def job_bundle(spark, sf_dir):
    a = cart(spark, sf_dir)
    lattice = corpus.with_lattice(corpus.structures(spark, sf_dir))
    incar = lattice.select("structure_id", writers.fill("SYSTEM = SYSTEM_NAME\nNSW = 200\n", {"SYSTEM_NAME": F.col("structure_id").cast("string")}).alias("text"))
    files = decks.bundle(POSCAR=writers.poscar(a), KPOINTS=writers.kpoints(lattice), INCAR=incar)
    return files.select("structure_id", "filename", F.length("text").alias("n_chars"), F.md5("text").alias("md5"))


# logs

_STEPS = """sp AS (SELECT system, count(*) FILTER (WHERE event_type <> 'error') AS ionic, coalesce(sum(CASE WHEN event_type <> 'error' THEN event_id % 4 END), 0) AS electronic, coalesce(arg_max(event_id % 4, step) FILTER (WHERE event_type <> 'error'), 0) AS last, arg_max(value, step) FILTER (WHERE event_type <> 'error') AS energy FROM ev GROUP BY system)"""


@query(f"""WITH {_CHAIN}, {_STEPS} SELECT system, CASE WHEN system % 9 <> 0 THEN CAST(ionic AS INT) END AS ionic_iterations, CASE WHEN system % 9 <> 0 THEN CAST(electronic AS INT) END AS total_electronic_iterations, CASE WHEN system % 9 <> 0 THEN CAST(last AS INT) END AS last_electronic_iterations,
CASE WHEN system % 9 <> 0 THEN {rs('energy', 'final_energy_ev').replace(' AS final_energy_ev', '')} END AS final_energy_ev, CASE WHEN system % 9 <> 0 THEN last < 3 END AS converged_electronic, CASE WHEN system % 9 <> 0 THEN 40 > ionic END AS converged_ionic, system % 9 = 0 AS broken FROM sp""")
def calculation_xml(spark, sf_dir):
    docs = xml_docs(spark, sf_dir)
    found = calculations.calculation_xml(F.col("xml"))
    return docs.withColumns(found).select("system", "ionic_iterations", "total_electronic_iterations", "last_electronic_iterations", r6("final_energy_ev").alias("final_energy_ev"), "converged_electronic", "converged_ionic", F.col("parse_error").isNotNull().alias("broken"))


def xml_docs(spark, sf_dir):
    """XML outputs made of the events: one ionic step an event, cut short for every ninth system."""
    step = F.when(F.col("event_type") != "error", F.concat(F.lit("<calculation>"), F.repeat(F.lit("<scstep><time>1 1</time></scstep>"), (F.col("event_id") % 4).cast("int")), F.lit('<energy><i name="e_fr_energy"> 1.0 </i><i name="e_0_energy"> '), F.col("value").cast("string"), F.lit(" </i></energy></calculation>")))
    doc = F.concat(F.lit('<?xml version="1.0"?>\n<modeling>\n<incar><i type="int" name="NELM"> 3</i><i type="int" name="NSW"> 40</i></incar>\n'), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step", step.alias("x")))), lambda s: F.coalesce(s["x"], F.lit(""))), "\n"), F.lit("\n</modeling>\n"))
    docs = chain(spark, sf_dir).groupBy("system").agg(doc.alias("xml"))
    return docs.withColumn("xml", F.when(F.col("system") % 9 == 0, F.expr("substring(xml, 1, length(xml) - 15)")).otherwise(F.col("xml")))


@query(f"""WITH {_CHAIN}, {_STEPS}, su AS (SELECT system % 20 AS s, system % 7 <> 0 AS good, system // 20 AS k, system % 9 <> 0 AS whole, energy, CASE WHEN system % 7 = 0 THEN 'old' ELSE '' END || (system // 20) || '/vasprun.xml' AS relative_path FROM sp),
nu AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY good, CASE WHEN good THEN k END, relative_path) AS n, count(*) OVER (PARTITION BY s) AS m FROM su)
SELECT CAST(s AS VARCHAR) AS system, relative_path, CAST(n AS INT) AS position, m AS calculation_count, n = m AS is_latest_calculation, NOT good AS chain_error, CASE WHEN whole THEN {rs('energy', 'e').replace(' AS e', '')} END AS final_energy_ev FROM nu""")
def system_summary(spark, sf_dir):
    k = F.expr("system div 20").cast("string")
    runs = xml_docs(spark, sf_dir).select((F.col("system") % 20).cast("string").alias("system"), F.concat(F.when(F.col("system") % 7 == 0, "old").otherwise(""), k, F.lit("/vasprun.xml")).alias("relative_path"), F.col("xml").alias("text"))
    found = results.system_summary(runs)
    return found.select("system", "relative_path", "position", "calculation_count", "is_latest_calculation", F.col("chain_error").isNotNull().alias("chain_error"), r6("final_energy_ev").alias("final_energy_ev"))


@query(f"WITH {_CHAIN} SELECT system, {rs('coalesce(max(value) FILTER (WHERE event_type = $$click$$), arg_max(value, step))', 'cpu_seconds')} FROM ev GROUP BY system")
def fallback_cpu(spark, sf_dir):
    """An explicit line (the largest click) goes before the last time pair."""
    e = chain(spark, sf_dir).groupBy("system").agg(
        F.max(F.when(F.col("event_type") == "click", F.col("value"))).alias("c"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step", "value"))), lambda x: F.concat(F.lit('<time name="totalsc"> '), x["value"].cast("string"), F.lit(" 1.0</time>"))), "\n").alias("t"),
    )
    log = F.concat(F.col("t"), F.coalesce(F.concat(F.lit("\nTotal CPU time used (sec): "), F.col("c").cast("string")), F.lit("")))
    return e.select("system", r6(calculations.fallback_cpu_seconds(log)).alias("cpu_seconds"))


@query("WITH p AS (SELECT o_orderkey AS id, o_custkey % 5 AS a, o_orderkey % 3 AS b FROM orders) SELECT id, CASE WHEN a = 0 THEN NULL WHEN b = 0 THEN '0' WHEN b = 1 THEN CAST(a AS VARCHAR) ELSE a || '.' || a END AS chain FROM p")
def chain_of_path(spark, sf_dir):
    a, b = F.col("o_custkey") % 5, F.col("o_orderkey") % 3
    folder = F.when(a == 0, F.lit("x/")).otherwise(F.when(b == 0, "").when(b == 1, F.concat(a.cast("string"), F.lit("/"))).otherwise(F.concat_ws("/", a.cast("string"), a.cast("string"), F.lit(""))))
    found = calculations.numeric_chain(F.concat(folder, F.lit("vasprun.xml")))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(found.isNotNull(), F.coalesce(F.nullif(F.array_join(found.cast("array<string>"), "."), F.lit("")), F.lit("0"))).alias("chain"))


@query()
def manifest_summary(spark, sf_dir):
    entries = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("system"), F.array().cast("array<string>").alias("chain"), F.col("event_type").alias("filename"))
    return calculations.manifest_text(entries, "/calc", ["click", "purchase", "view", "error", "scroll_depth"])


@query("WITH f AS (SELECT l_suppkey AS system, l_orderkey % 3 AS d, l_orderkey % 12 AS s FROM lineitem), p AS (SELECT DISTINCT system, CASE d WHEN 0 THEN 'C' WHEN 1 THEN s || '/C' ELSE s || '/' || s || '/C' END AS path, d, s FROM f) SELECT system, max(path) AS by_text, arg_max(path, (d, path)) AS by_depth, arg_max(path, (d, s)) AS by_chain FROM p GROUP BY system")
def latest_paths(spark, sf_dir):
    d, s = F.col("l_orderkey") % 3, (F.col("l_orderkey") % 12).cast("string")
    path = F.when(d == 0, "C").when(d == 1, F.concat_ws("/", s, F.lit("C"))).otherwise(F.concat_ws("/", s, s, F.lit("C")))
    files = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("system"), path.alias("path")).distinct().withColumn("relative_path", F.col("path"))
    out = reports.latest_path(files, "text").withColumnRenamed("path", "by_text")
    for order in ("depth", "chain"):
        out = out.join(reports.latest_path(files, order).withColumnRenamed("path", f"by_{order}"), "system")
    return out


@query("SELECT round(min(c_acctbal) - 0.05 * (max(c_acctbal) - min(c_acctbal)), 4) AS low, round(max(c_acctbal) + 0.05 * (max(c_acctbal) - min(c_acctbal)), 4) AS high FROM customer")
def axis_limits(spark, sf_dir):
    return reports.axis_limits(table(spark, sf_dir, "customer"), "c_acctbal").select(F.round("low", 4).alias("low"), F.round("high", 4).alias("high"))


# molecules


@query(f"""{W_}, {_UNIQUE}, ca AS (SELECT *, coalesce(TRY_CAST(nullif(regexp_extract(formula, 'C([0-9]+)', 1), '') AS INT), 0) AS carbons FROM uq WHERE formula <> 'H2O1'),
rk AS (SELECT *, row_number() OVER (PARTITION BY structure_id ORDER BY carbons > 0 DESC, n_atoms DESC, carbons DESC, copies DESC, component) AS r FROM ca) SELECT structure_id, component, n_atoms, formula, copies FROM rk WHERE r = 1""")
def chosen_molecule(spark, sf_dir):
    return reports.chosen_molecules(*unique(spark, sf_dir))


@query()
def branch_report(spark, sf_dir):
    return reports.branch_report(cart(spark, sf_dir))[1]


_OPEN = f"""{ELEMENTS_SQL}, ro AS (SELECT cart.*, radius FROM cart JOIN el USING (element)), ob AS (SELECT a.structure_id, a.atom_idx AS i, b.atom_idx AS j, sqrt((b.x-a.x)**2 + (b.y-a.y)**2 + (b.z-a.z)**2) AS distance, 1.2 * (a.radius + b.radius) AS longest FROM ro a JOIN ro b ON a.structure_id = b.structure_id AND a.atom_idx < b.atom_idx)"""


def near_points(spark, sf_dir):
    points = cart(spark, sf_dir).select("structure_id", F.col("atom_idx").alias("idx"), "element", "x", "y", "z")
    return reports.open_bonds(points, dims.elements(spark), keys=["structure_id"])


@query(f"{W_}, {_OPEN} SELECT structure_id, i, j, {rs('distance', 'distance')} FROM ob WHERE distance <= longest")
def open_bond_join(spark, sf_dir):
    return near_points(spark, sf_dir).select("structure_id", "i", "j", r6("distance").alias("distance"))


@query(f"{W_}, {_OPEN}, ev_ AS (SELECT structure_id, atom_idx - 1 AS i, atom_idx AS j, 0 AS k, 'construction' AS kind FROM atoms WHERE atom_idx >= 1 UNION ALL SELECT structure_id, i, j, 1, 'inferred' FROM ob WHERE distance <= longest) SELECT structure_id, i, j, arg_min(kind, k) AS kind FROM ev_ GROUP BY ALL")
def viewer_bonds(spark, sf_dir):
    built = corpus.atoms(spark, sf_dir).where("atom_idx >= 1").select("structure_id", F.col("atom_idx").alias("i"), (F.col("atom_idx") - 1).alias("j"))
    return reports.merged_bonds(["structure_id"], construction=built, inferred=near_points(spark, sf_dir))


@query(f"{W_} SELECT CAST(structure_id AS VARCHAR) AS mol_id, atom_idx + 1 AS row_index, 'bond differs' AS warning FROM atoms WHERE atom_idx >= 1 AND structure_id % 5 = 0")
def geometry_warnings(spark, sf_dir):
    rows = zrows(spark, sf_dir)
    off = rows.withColumn("bond_length", F.col("bond_length") + F.when(F.col("mol_id").cast("long") % 5 == 0, 0.01).otherwise(0.0))
    return reports.geometry_warnings(off, zmatrix.cartesian(rows)).where("warning LIKE 'bond%'")


@query(f"""{W_} SELECT a.structure_id, a.atom_idx AS i, b.atom_idx AS j, {', '.join(f"CAST(-round_even(b.f{c} - a.f{c}, 0) AS INT) AS s{c}" for c in 'xyz')} FROM atoms a JOIN atoms b ON a.structure_id = b.structure_id AND b.atom_idx = a.atom_idx + 1""")
def template_bonds(spark, sf_dir):
    a = corpus.with_lattice(corpus.atoms(spark, sf_dir))
    links = a.where("atom_idx >= 1").select("structure_id", (F.col("atom_idx") - 1).alias("i"), F.col("atom_idx").alias("j"))
    return reports.template_bonds(links, a).select("structure_id", "i", "j", "sx", "sy", "sz")


@query()
def projected_points(spark, sf_dir):
    return reports.projection(cart(spark, sf_dir)).select("structure_id", "atom_idx", r6("u").alias("u"), r6("v").alias("v"))


@query(f"{W_}, n AS (SELECT structure_id, element, count(*) AS k FROM atoms GROUP BY ALL) SELECT structure_id, element AS center_element, round(k / sum(k) OVER (PARTITION BY structure_id), 9) AS weight FROM n")
def pdd_weights(spark, sf_dir):
    d = pdd.descriptors(cart(spark, sf_dir), k=4)
    return d.groupBy("structure_id", "center_element").agg(F.round(F.sum("weight"), 9).alias("weight"))


@query("SELECT s_suppkey AS id, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY CASE WHEN s_suppkey % 7 = 0 THEN 0 WHEN s_suppkey % 2 = 0 THEN 1 ELSE 2 END, CASE WHEN s_suppkey % 7 <> 0 AND s_suppkey % 2 = 0 THEN s_suppkey % 11 END, s_name, s_suppkey) AS INT) AS place FROM supplier")
def stage_label_order(spark, sf_dir):
    k = F.col("s_suppkey")
    label = F.when(k % 7 == 0, "self").when(k % 2 == 0, (k % 11).cast("string")).otherwise(F.col("s_name"))
    s = table(spark, sf_dir, "supplier").withColumn("label", label)
    keys = calculations.stage_order(F.col("label"), F.lit("self"))[:2]
    return s.select(k.alias("id"), F.row_number().over(W.partitionBy("s_nationkey").orderBy(*keys, "s_name", "s_suppkey")).alias("place"))


# files of Z-matrices, comparisons, result tables


@query(f"""{W_} SELECT CAST(structure_id AS VARCHAR) AS mol_id, atom_idx + 1 AS row_index, element || row_number() OVER (PARTITION BY structure_id, element ORDER BY atom_idx) AS label, element, CASE WHEN atom_idx >= 1 THEN atom_idx END AS bond_to, {rs('CASE WHEN atom_idx >= 1 THEN 1.0 + fx END', 'bond_length')}, {rs('CASE WHEN atom_idx >= 2 THEN 60.0 + 100.0 * fy END', 'angle_deg')} FROM atoms""")
def zmatrix_documents(spark, sf_dir):
    texts = writers.zmatrix(zrows(spark, sf_dir)).select(F.concat("mol_id", F.lit(".zmat")).alias("path"), "text")
    rows = zmatrix_files.atom_rows(zmatrix_files.documents(texts))
    return rows.select("mol_id", "row_index", "label", "element", "bond_to", r6("bond_length").alias("bond_length"), r6("angle_deg").alias("angle_deg"))


@query(f"{W_} SELECT CAST(structure_id AS VARCHAR) AS mol_id, atom_idx AS i, atom_idx + 1 AS j FROM atoms WHERE atom_idx >= 1")
def zmatrix_bonds(spark, sf_dir):
    texts = decks.zmatrix_text(zrows(spark, sf_dir), ["mol_id"], F.col("mol_id")).select(F.concat("mol_id", F.lit(".zmat")).alias("path"), "text")
    return zmatrix_files.bond_rows(zmatrix_files.documents(texts))


@query(f"""{W_}, c AS (SELECT structure_id, string_agg(element || '_' || atom_idx, ',' ORDER BY atom_idx) AS last FROM atoms GROUP BY ALL), f AS (SELECT last, min(structure_id) AS id FROM c WHERE structure_id % 2 = 0 GROUP BY ALL)
SELECT a.structure_id, f.id AS mol_id, CASE WHEN f.id IS NOT NULL THEN a.atom_idx END AS row_index, CASE WHEN f.id IS NOT NULL THEN a.atom_idx END AS atom_idx FROM atoms a JOIN c USING (structure_id) LEFT JOIN f USING (last) WHERE f.id IS NOT NULL OR a.atom_idx = 0""")
def label_match(spark, sf_dir):
    """Structures take the order of the first even structure with their labels."""
    a = corpus.atoms(spark, sf_dir).select("structure_id", F.lit(0).alias("component"), "atom_idx", F.concat_ws("_", "element", "atom_idx").alias("label"))
    rows = a.where("structure_id % 2 = 0").select(F.col("structure_id").alias("mol_id"), F.col("atom_idx").alias("row_index"), "label")
    return zmatrix_files.matched(a, rows).drop("component")


@query()
def round_trip(spark, sf_dir):
    """Full cells reduced and expanded anew, held against themselves site by site and by fingerprints (k = 100)."""
    sites = symmetry.expand(corpus.atoms(spark, sf_dir), ops(spark))
    full = sites.select("structure_id", *compare.CELL, (F.row_number().over(W.partitionBy("structure_id").orderBy("atom_idx", "op_idx")) - 1).alias("atom_idx"), F.col("site_label").alias("label"), "element", F.col("gx").alias("fx"), F.col("gy").alias("fy"), F.col("gz").alias("fz"))
    found = compare.round_trip(full)
    return found.select("structure_id", "full_atoms", "n_unique", "rebuilt_atoms", "n_operations", *[F.round(c, 4).alias(c) for c in ("displacement_to_full", "distance_to_full")])


@query("SELECT coalesce(x.s, k.s) AS status, coalesce(n, 0) AS n FROM (VALUES ('F'), ('X')) x(s) FULL OUTER JOIN (SELECT o_orderstatus AS s, count(*) AS n FROM orders GROUP BY ALL) k ON x.s = k.s")
def status_counts(spark, sf_dir):
    return results.status_counts(table(spark, sf_dir, "orders"), ["F", "X"], "o_orderstatus")


@query("SELECT o_orderpriority AS value, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM orders GROUP BY ALL")
def value_distribution(spark, sf_dir):
    return results.distribution(table(spark, sf_dir, "orders"), "o_orderpriority").withColumn("share", F.round("share", 6))


@query("SELECT DISTINCT c_custkey AS identifier, c_name AS label FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def highlighted_points(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("identifier"), F.col("c_name").alias("label"))
    return results.highlighted(c, table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("identifier")))
