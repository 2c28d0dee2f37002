"""Input decks of simulation codes, as text columns, and job folders.

A deck is one row; its lines are ordered arrays joined inside the JVM. Job
folders go through the committed sinks in ``folders``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from pathlib import Path, PurePosixPath

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from crystalspark.sources import folders, writers

PARTS = ("bond", "angle", "dihedral")


@dataclass(frozen=True)
class GaussianDeck:
    """Settings of a molecule's optimisation; optional keywords that are empty or ``none`` are left out.

    The defaults are fixed values of the format of these decks.
    """

    chk: str = "hess.chk"
    mem: str = "32000MB"
    nprocshared: int = 8
    functional: str = "PBE1PBE"
    basis_set: str = "6-311G(d,p)"
    charge: int = 0
    multiplicity: int = 1
    opt: str | None = "Z-matrix, CalcAll,MaxCycle=150,MaxStep=20"
    integral: str | None = "ultrafine"
    scf: str | None = "QC"
    pop: str | None = "hlygat"
    others: str | None = "nosymm"
    pcm_eps: float | None = 11.0
    title: str = "Gas-phase optimization from crystal"
    walltime: str = "6:00:00"
    pbs_select: str = "1:ncpus=16:mpiprocs=16:mem=40gb"
    array_range: str = "1-2"
    gaussian_command: str = "g16"
    formchk_command: str = "formchk"

    def route(self) -> str:
        given = {k: v.strip() for k in ("integral", "others", "opt", "pop", "scf") if (v := getattr(self, k)) and v.strip().lower() not in ("", "none")}
        keywords = [given[k] if k == "others" else f"{'int' if k == 'integral' else k}=({given[k]})" for k in ("integral", "others", "opt", "pop", "scf") if k in given]
        solvent = [] if self.pcm_eps is None else ["scrf=(PCM,Read)"]
        return " ".join([f"#P {self.functional}/{self.basis_set}", *keywords, *solvent])

    def formatted_checkpoint(self) -> str:
        path = PurePosixPath(self.chk)
        return path.with_suffix(".fchk").name if path.suffix.lower() == ".chk" else f"{path.name}.fchk"


def _grouped(rows: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """One row a group with ``rows``, its rows as structs in order."""
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, *columns))).alias("rows"))


def _references(x: Column) -> list[tuple[Column, str]]:
    return [(x[f"{p}_to"], p) for p in PARTS]


VALUES = {"bond": ("bnd", "bond_length"), "angle": ("ang", "angle_deg"), "dihedral": ("dih", "dihedral_deg")}
ZCOLUMNS = ["element", "bond_to", "bond_length", "angle_to", "angle_deg", "dihedral_to", "dihedral_deg"]


def gaussian(rows: DataFrame, keys: list[str], deck: GaussianDeck = GaussianDeck()) -> DataFrame:
    """(keys, text): the symbolic Z-matrix of each molecule, then its variables and constants.

    A molecule with a row that lacks a reference or a value gets a null text
    and an ``error`` that names the row.
    """
    def atom(x: Column) -> Column:
        n = x["row_index"].cast("string")
        return F.concat_ws(" ", x["element"], *[y for ref, p in _references(x) for y in (ref.cast("string"), F.when(ref.isNotNull(), F.concat(F.lit(VALUES[p][0]), n)))])

    def variables(x: Column) -> Column:
        n = x["row_index"].cast("string")
        made = [F.when(ref.isNotNull(), F.concat(F.lit(VALUES[p][0]), n, F.lit("="), F.format_string("%.6f", x[VALUES[p][1]]))) for ref, p in _references(x)]
        return F.filter(F.array(*made), lambda y: y.isNotNull())

    head = "\n".join([f"%chk={deck.chk}", f"%mem={deck.mem}", f"%nprocshared={deck.nprocshared}", deck.route(), "", deck.title, "", f"{deck.charge} {deck.multiplicity}"])
    constants = [] if deck.pcm_eps is None else [F.lit(f"EPS={deck.pcm_eps:.1f}")]
    given = lambda x: sum((ref.isNotNull() & x[VALUES[p][1]].isNotNull()).cast("int") for ref, p in _references(x))
    broken = F.filter("rows", lambda x: given(x) < F.least(x["row_index"] - 1, F.lit(3)))
    lines = [F.lit(head), F.array_join(F.transform("rows", atom), "\n"), F.lit(""), F.lit("Variables:")]
    numbers = F.nullif(F.array_join(F.flatten(F.transform("rows", variables)), "\n"), F.lit(""))
    text = F.concat_ws("\n", *lines, numbers, F.lit("Constants:"), *constants, F.lit(""), F.lit(""))
    bad = F.size(broken) > 0
    return _grouped(rows, keys, "row_index", ZCOLUMNS).select(*keys, F.when(~bad, text).alias("text"), F.when(bad, F.concat(F.lit("missing definition at row "), F.get(broken, F.lit(0))["row_index"].cast("string"))).alias("error"))


def zmatrix_text(rows: DataFrame, keys: list[str], title: Column) -> DataFrame:
    """(keys, text): a numeric Z-matrix with its bonds and torsions listed above the rows."""
    bonded = F.filter("rows", lambda x: x["bond_to"].isNotNull())
    turning = F.filter("rows", lambda x: x["bond_to"].isNotNull() & x["angle_to"].isNotNull() & x["dihedral_to"].isNotNull())
    bonds = F.array_join(F.transform(bonded, lambda x: F.concat_ws("-", x["bond_to"], x["row_index"])), " ")
    torsions = F.transform(turning, lambda x, k: F.format_string("# torsion %d: %d-%d-%d-%d bond %d-%d", k, x["row_index"], x["dihedral_to"], x["angle_to"], x["bond_to"], x["row_index"], x["bond_to"]))

    def row(x: Column) -> Column:
        both = lambda p: x[f"{p}_to"].isNotNull() & x[VALUES[p][1]].isNotNull()
        return F.concat_ws(" ", x["element"], *[F.when(both(p), F.format_string("%d %.10f", x[f"{p}_to"], x[VALUES[p][1]])) for p in PARTS])

    body = F.concat(torsions, F.transform("rows", row))
    grouped = _grouped(rows.withColumn("_title", title), [*keys, "_title"], "row_index", ZCOLUMNS)
    text = F.concat(F.lit("# ZMAT v1\n# title: "), "_title", F.lit("\n# bonds: "), bonds, F.lit("\n"), F.array_join(body, "\n"), F.lit("\n"))
    return grouped.select(*keys, text.alias("text"))


def gaussian_script(template: str, job: Column, deck: GaussianDeck = GaussianDeck()) -> Column:
    """A run script: the template's queue lines and commands replaced by the deck's."""
    given = {
        "#PBS -lwalltime=": f"#PBS -lwalltime={deck.walltime}", "#PBS -l select=": f"#PBS -l select={deck.pbs_select}", "#PBS -J ": f"#PBS -J {deck.array_range}",
        "g16 ${name}.com ${name}.log": f"{deck.gaussian_command} ${{name}}.com ${{name}}.log", "formchk -3 ": f"{deck.formchk_command} -3 {deck.chk} {deck.formatted_checkpoint()}",
    }

    def replaced(line: str) -> str:
        spaced = " ".join(line.split()) if line.startswith("g16") else line
        return next((new for start, new in given.items() if spaced.startswith(start) and (start[:3] != "g16" or spaced == start)), line)

    text = "\n".join(map(replaced, template.rstrip().split("\n"))) + "\n"
    return F.replace(F.lit(text), F.lit("SYSTEM_NAME"), job)


def rigid_info(molecules: DataFrame, exp_ulatt: float = 0.0, pressure: float = 0.0, scal_disp: float = 1.0, scal_elec: float = 1.0, charge: int = 0, multiplicity: int = 1) -> DataFrame:
    """(structure_id, text): the counts file of a rigid-molecule search, molecules from the heaviest, ties by component."""
    sizes = F.transform(F.array_sort(F.collect_list(F.struct((-F.round("weight", 6)).alias("w"), "component", "n_atoms"))), lambda x: x["n_atoms"].cast("string"))
    each = lambda v: F.array_join(F.transform("n", lambda _: F.lit(str(v))), " ")
    text = F.concat_ws(
        "\n", F.concat(F.lit("Num_Mols_Asm "), F.size("n").cast("string")), F.concat(F.lit("Num_Atoms "), F.array_join("n", " ")), F.lit(f"exp_Ulatt {exp_ulatt}"), F.lit(f"Pressure {pressure}"),
        *[F.concat(F.lit(f"{name} "), each(v)) for name, v in (("scal_disp", scal_disp), ("scal_elec", scal_elec), ("Charges", charge), ("Multiplicity", multiplicity))], F.lit(""),
    )
    return molecules.groupBy("structure_id").agg(sizes.alias("n")).select("structure_id", text.alias("text"))


def rigid_input(template: str, system: Column, potential: str) -> Column:
    """The search's input: system name filled in, and the potential's file named."""
    named = re.sub(r"(?m)^(\s*RD filename:\s+).*$", lambda m: m.group(1) + potential, template)
    return writers.fill(named, {"DUMMEY_SYSTEM_NAME": system, "DUMMY_SYSTEM_NAME": system, "SYSTEM_NAME": system})


#: Energy of a gas-phase water molecule in Hartree (fixed value).
WATER_ENERGY = -76.3688745965


def flexible_molecules(unique: DataFrame, system: Column, energy: Column, job_dir: str, water: str = "WATER", charge: int = 0, multiplicity: int = 1) -> DataFrame:
    """Definitions of each structure's unique molecules (structure_id, representative, n_atoms, formula), in order of their representatives.

    Water has its own name and energy; every other molecule has the system's.
    """
    is_water = F.col("formula") == "H2O1"
    index = F.row_number().over(W.partitionBy("structure_id").orderBy("representative"))
    path = lambda kind: F.concat(F.lit(f"{job_dir.rstrip('/')}/{kind}_lam_global_"), "index")
    return unique.withColumn("index", index).select(
        "structure_id", "index", F.when(is_water, water).otherwise(system).alias("molecule_name"), "n_atoms", F.lit(charge).alias("charge"), F.lit(multiplicity).alias("multiplicity"),
        F.when(is_water, WATER_ENERGY).otherwise(energy).alias("energy"), path("intra").alias("global_intra"), path("elec").alias("global_elec"),
    )


#: Frame of a molecule definition file (fixed text of the format).
MOLECULE_HEAD = """{bar}
#                                Molecule Definition File                                  #
{bar}
\x20\x20
Nmol_asm  %d       #number of distinct molecules present in the .res file\x20\x20\x20\x20
Nmol_unique  %d    #number of unique molecules present in the .res file

{bar}
#      Molecules entered in the order they are processed in the specified .res file        #
#               Dashed lines (------) are used as dividers between entries                 #
{bar}

""".replace("{bar}", "#" * 92)
MOLECULE_ENTRY = """{rule}
Number of molecules  1
Molecule Name        %s
nAtoms               %d
Charge               %d
Multiplicity         %d
scal_disp            1.0
scal_elec            1.0
Gas phase energy     %.10f  Hartree\x20\x20

# Database file names and paths\x20
Local intra     './intra_lam_tmp_%d'                         #Should be referenced locally
Global intra    '%s'
Local elec      './elec_lam_tmp_%d'                         #Should be referenced locally
Global elec     '%s'    #Should be referenced globally
""".replace("{rule}", "-" * 92)


def flexible_input(definitions: DataFrame) -> DataFrame:
    """(structure_id, text): the molecule definition file of each structure."""
    columns = ["molecule_name", "n_atoms", "charge", "multiplicity", "energy", "global_intra", "global_elec"]
    entry = lambda x: F.format_string(MOLECULE_ENTRY, x["molecule_name"], x["n_atoms"], x["charge"], x["multiplicity"], x["energy"], x["index"], x["global_intra"], x["index"], x["global_elec"])
    n = F.size("rows")
    return _grouped(definitions, ["structure_id"], "index", columns).select(
        "structure_id", F.concat(F.format_string(MOLECULE_HEAD, n, n), F.array_join(F.transform("rows", entry), ""), F.lit("-" * 92 + "\n")).alias("text")
    )


def flexible_zmatrix(rows: DataFrame) -> DataFrame:
    """(structure_id, text): labels and reference labels of every molecule's rows (structure_id, molecule, row_index, label, references)."""
    names = F.transform("rows", lambda x: x["label"])
    line = lambda x: F.concat_ws("    ", x["label"], *[F.get(F.col("names"), ref - 1) for ref, _ in _references(x)])
    one = _grouped(rows, ["structure_id", "molecule"], "row_index", ["label", *[f"{p}_to" for p in PARTS]]).withColumn("names", names)
    one = one.select("structure_id", "molecule", F.array_join(F.transform("rows", line), "\n").alias("body"))
    return _grouped(one, ["structure_id"], "molecule", ["body"]).select(
        "structure_id", F.concat(F.array_join(F.transform("rows", lambda x, k: F.concat(F.format_string("Z-matrix for molecule %d\n", k + 1), x["body"])), "\n"), F.lit("\n")).alias("text")
    )


def flexible_script(template: str, system: Column, work_dir: str, walltime: str, use_dof: bool) -> Column:
    """A run script of a flexible search; without a file of degrees of freedom their flag goes."""
    text = re.sub(r"(?m)^#PBS -l walltime=.*$", lambda _: f"#PBS -l walltime={walltime}", template)
    if not use_dof:
        text = re.sub(r" DOF(\"?) (>|2>&1)", r"\1 \2", text)
    return writers.fill(text, {"SYSTEM_NAME": system, "HPC_WORKDIR": F.lit(work_dir)})


def batch_script(run_script: str) -> str:
    """A shell script that submits ``run_script`` in every folder below its own that holds one, in order of name."""
    return f"""#!/bin/bash
set -eu
root="${{1:-$(cd -- "$(dirname -- "$0")" && pwd)}}"
for folder in "$root"/*/; do
    [ -f "$folder/{run_script}" ] || continue
    echo "Submitting $(basename "$folder") with qsub {run_script}"
    (cd "$folder" && qsub {run_script})
done
"""


def potcar(atoms: DataFrame, potentials: DataFrame) -> DataFrame:
    """(structure_id, text, missing): potential texts (element, potential) in order of the elements' first atoms.

    Elements without one are listed in ``missing`` and leave the text null.
    """
    first = atoms.groupBy("structure_id", "element").agg(F.min("atom_idx").alias("first"))
    joined = first.join(F.broadcast(potentials), "element", "left")
    rows = F.array_sort(F.collect_list(F.struct("first", "element", "potential")))
    gaps = F.transform(F.filter("rows", lambda x: x["potential"].isNull()), lambda x: x["element"])
    return joined.groupBy("structure_id").agg(rows.alias("rows")).select(
        "structure_id", F.when(F.size(gaps) == 0, F.array_join(F.transform("rows", lambda x: x["potential"]), "")).alias("text"), gaps.alias("missing")
    )


def bundle(**files: DataFrame) -> DataFrame:
    """(structure_id, filename, text) of decks (structure_id, text) given by file name; dots in names are written ``__``."""
    parts = [df.select("structure_id", F.lit(name.replace("__", ".")).alias("filename"), "text") for name, df in files.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_bundle(files: DataFrame, root: str, name: str = "structure_id") -> None:
    """Write (name, filename, text) rows as ``root/name/filename``, all or none (see ``folders``); scripts become executable, null texts are left out."""
    folder = F.regexp_replace(F.col(name).cast("string"), r"[^A-Za-z0-9_.-]+", "_")
    folders.write_files(files.where("text IS NOT NULL").select(F.concat_ws("/", folder, "filename").alias("path"), F.col("text").cast("binary").alias("content")), root)


def archive(entries: DataFrame, path: str, apply: bool = False) -> Path:
    """A tar.gz of manifest entries (path, relative_path) in order of path, compressed by tasks; nothing is written unless ``apply``."""
    target = Path(path)
    if apply:
        target.parent.mkdir(parents=True, exist_ok=True)
        folders.write_archive(entries, str(target))
    return target
