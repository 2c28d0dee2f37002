"""Logs of simulation runs: markers, energies, health, chains and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from crystalspark.functions import text as t

ACCURACY = "reached required accuracy - stopping structural energy minimisation"
TIMING = "General timing and accounting"
#: Files expected in each calculation folder (fixed values).
FILES = ["INCAR", "POSCAR", "CONTCAR", "vasprun.xml", "vasp.out", "OUTCAR"]


def run_log(c: Column) -> dict[str, Column]:
    """Columns of a run's standard output; null when the file is missing."""
    lines = F.filter(F.split(c, "\\r?\\n"), lambda x: x.contains("F="))
    last = F.try_element_at(lines, F.lit(-1))
    energy = F.nullif(F.regexp_extract(last, r"\bF=\s*" + t.NUMBER, 1), F.lit("")).try_cast("double")
    return {
        "out_converged": c.contains(ACCURACY),
        "free_energy": energy,
        "energy_sigma0": F.nullif(F.regexp_extract(last, r"\bE0=\s*" + t.NUMBER, 1), F.lit("")).try_cast("double"),
        "iteration": F.when(energy.isNotNull(), F.nullif(F.trim(F.substring_index(last, "F=", 1)), F.lit(""))),
        "out_markers": t.fatal_markers(c),
    }


def summary_log(c: Column) -> dict[str, Column]:
    """Columns of a run's closing summary; null when the file is missing."""
    number = lambda p: F.nullif(F.regexp_extract(c, p, 1), F.lit("")).try_cast("double")
    return {
        "summary_accuracy": c.contains(ACCURACY),
        "summary_timing": c.contains(TIMING),
        "cpu_seconds": number(r"(?i)Total CPU time used \(sec\)\s*:\s*([0-9.+\-Ee]+)"),
        "memory_kb": number(r"(?i)Maximum memory used \(kb\)\s*:\s*([0-9.+\-Ee]+)"),
        "summary_markers": t.fatal_markers(c),
    }


def health(fatal: Column, timing: Column, accuracy: Column, converged: Column, energy: Column, any_file: Column) -> Column:
    """State of a calculation; nulls count as false."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(yes(fatal), "failed").when(yes(timing) & (yes(accuracy) | yes(converged)), "completed_converged").when(yes(timing), "completed_unconverged")
        .when(yes(converged), "completed_converged").when(energy.isNotNull(), "incomplete_or_running").when(~yes(any_file), "missing_output").otherwise("unknown")
    )


def classify(logs: DataFrame) -> DataFrame:
    """Adds log columns, ``markers`` and ``status`` to rows with the texts ``out`` and ``summary`` and the flag ``has_xml``."""
    df = logs.withColumns(run_log(F.col("out")) | summary_log(F.col("summary")))
    markers = F.array_distinct(F.concat(F.coalesce("out_markers", F.array().cast("array<string>")), F.coalesce("summary_markers", F.array().cast("array<string>"))))
    any_file = F.col("out").isNotNull() | F.col("summary").isNotNull() | F.coalesce("has_xml", F.lit(False))
    return df.withColumn("markers", markers).withColumn("status", health(F.size("markers") > 0, F.col("summary_timing"), F.col("summary_accuracy"), F.col("out_converged"), F.col("free_energy"), any_file)).drop("out_markers", "summary_markers")


def last_energy(c: Column) -> Column:
    """Energy of the last ``SCF Done`` line of a Gaussian log."""
    found = F.regexp_extract_all(c, F.lit(r"SCF Done:[^\n=]*=\s*(-?[0-9.]+(?:[EeDd][+-]?[0-9]+)?)"), 1)
    return F.replace(F.try_element_at(found, F.lit(-1)), F.lit("D"), F.lit("E")).try_cast("double")


def manifest(files: DataFrame, root: str) -> DataFrame:
    """System, chain and name of listed files (path, length) under ``root``."""
    relative = F.split(F.substring(F.col("path"), len(root.rstrip("/")) + 2, 10_000), "/")
    df = files.withColumn("_parts", relative)
    return df.select(
        "path", F.array_join("_parts", "/").alias("relative_path"), F.col("_parts")[0].alias("system"),
        F.when(F.size("_parts") > 2, F.slice("_parts", 2, F.size("_parts") - 2)).otherwise(F.array().cast("array<string>")).alias("chain"), F.element_at("_parts", -1).alias("filename"), F.col("length").alias("size_bytes"),
    )


def manifest_counts(entries: DataFrame, expected: list[str] = FILES) -> DataFrame:
    """(filename, n) with zeros for expected names that are missing."""
    wanted = entries.sparkSession.createDataFrame([(e,) for e in expected], "filename string")
    return wanted.join(entries.groupBy("filename").agg(F.count("*").alias("k")), "filename", "full_outer").select("filename", F.coalesce("k", F.lit(0)).alias("n"))


def manifest_missing(entries: DataFrame, expected: list[str] = FILES) -> DataFrame:
    """(system, missing) of systems that lack an expected name, missing in the order expected."""
    have = entries.groupBy("system").agg(F.collect_set("filename").alias("have"))
    return have.select("system", F.array_except(F.array(*[F.lit(e) for e in expected]), "have").alias("missing")).where(F.size("missing") > 0)


def latest(calculations: DataFrame, system: str, order: list) -> DataFrame:
    """The last calculation of each system in the given descending order."""
    return calculations.withColumn("_r", F.row_number().over(W.partitionBy(system).orderBy(*order))).where("_r = 1").drop("_r")


def stage_order(label: Column, system: Column) -> list[Column]:
    """Sort keys of a stage label: the system itself, numbers, other names."""
    n = label.try_cast("int")
    return [F.when(label == system, 0).when(n.isNotNull(), 1).otherwise(2), n, label]


XML = "struct<calculation:array<struct<scstep:array<struct<time:array<string>>>,energy:struct<i:array<struct<_name:string,_VALUE:string>>>>>,_broken:string>"


def calculation_xml(c: Column) -> dict[str, Column]:
    """Columns of a run's XML output; a text that is no whole XML document gives nulls and ``parse_error``.

    The energy is that of the last ionic step (``e_0_energy``). Electrons have
    converged if the last step took fewer cycles than NELM (60 if not given),
    ions if NSW is at most 1 or exceeds the steps taken.
    """
    doc = F.from_xml(c, F.lit(XML), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken", "rowTag": "modeling"})
    whole = F.when(c.rlike(r"(?s)</modeling>\s*$"), doc)
    ok = whole["_broken"].isNull() & whole.isNotNull()
    steps = F.when(ok, F.coalesce(whole["calculation"], F.array().cast("array<" + XML.split("array<", 1)[1].rsplit(",_broken", 1)[0])))
    counts = F.transform(steps, lambda s: F.coalesce(F.size(s["scstep"]), F.lit(0)))
    last = F.try_element_at(steps, F.lit(-1))
    named = F.filter(last["energy"]["i"], lambda x: x["_name"] == "e_0_energy")
    setting = lambda name: F.try_element_at(F.regexp_extract_all(c, F.lit(rf'name="{name}"\s*>\s*(\d+)'), 1), F.lit(-1)).try_cast("int")
    cycles = F.coalesce(F.try_element_at(counts, F.lit(-1)), F.lit(0))
    electronic = F.when(ok, cycles < F.coalesce(setting("NELM"), F.lit(60)))
    nsw = F.coalesce(setting("NSW"), F.lit(0))
    ionic = F.when(ok, (nsw <= 1) | (nsw > F.size(steps)))
    return {
        "ionic_iterations": F.when(ok, F.size(steps)),
        "total_electronic_iterations": F.when(ok, F.aggregate(counts, F.lit(0), lambda a, x: a + x)),
        "last_electronic_iterations": F.when(ok, cycles),
        "final_energy_ev": F.trim(F.try_element_at(named, F.lit(-1))["_VALUE"]).try_cast("double"),
        "converged_electronic": electronic,
        "converged_ionic": ionic,
        "converged": electronic & ionic,
        "parse_error": F.when(c.isNotNull() & ~F.coalesce(ok, F.lit(False)), F.lit("not a whole XML document")),
    }


def fallback_cpu_seconds(c: Column) -> Column:
    """CPU seconds from a run's plain output: either explicit line, else the first of the last ``total`` or ``totalsc`` time pair."""
    explicit = [F.nullif(F.regexp_extract(c, p, 1), F.lit("")).try_cast("double") for p in (r"(?i)Total CPU time used \(sec\)\s*:\s*([0-9.+\-Ee]+)", r"(?i)cpu time\s*=\s*([0-9.+\-Ee]+)")]
    pairs = F.regexp_extract_all(c, F.lit(r'(?i)<time\s+name="(?:total|totalsc)"\s*>\s*([0-9.+\-Ee]+)\s+[0-9.+\-Ee]+\s*</time>'), 1)
    return F.coalesce(*explicit, F.try_element_at(pairs, F.lit(-1)).try_cast("double"))


def numeric_chain(relative: Column) -> Column:
    """Numbers of the folders on a relative path (without its file name); null if one is no number."""
    parts = F.filter(F.split(relative, "/"), lambda x: x != "")
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    numbers = F.transform(folders, lambda x: F.when(x.rlike(r"^\d+$"), x.try_cast("int")))
    return F.when(~F.exists(numbers, lambda x: x.isNull()), numbers)


def manifest_text(entries: DataFrame, root: str, expected: list[str] = FILES, listed: int = 20) -> DataFrame:
    """One row, ``text``: counts of a manifest, and the first ``listed`` systems in order of name that lack expected files."""
    totals = entries.agg(F.count("*").alias("files"), F.count_distinct("system").alias("systems"), F.count_distinct("system", "chain").alias("dirs"))
    names = manifest_counts(entries, expected).agg(F.array_sort(F.collect_list(F.struct("filename", "n"))).alias("counts"))
    gaps = manifest_missing(entries, expected)
    first = gaps.orderBy("system").limit(listed).agg(F.array_sort(F.collect_list(F.struct("system", "missing"))).alias("first"))
    df = totals.crossJoin(names).crossJoin(first).crossJoin(gaps.agg(F.count("*").alias("gaps")))
    lines = F.concat(
        F.array(F.lit(f"root={root}"), *[F.concat(F.lit(f"{label}="), F.col(c).cast("string")) for label, c in (("files", "files"), ("systems", "systems"), ("calculation_dirs", "dirs"))]),
        F.transform("counts", lambda x: F.concat_ws("=", x["filename"], x["n"])),
        F.when(F.col("gaps") == 0, F.array(F.lit("all_systems_have_expected_files=true"))).otherwise(F.concat(
            F.array(F.concat(F.lit("systems_with_missing_expected_files="), F.col("gaps").cast("string"))),
            F.transform("first", lambda x: F.concat(F.lit("missing "), x["system"], F.lit(": "), F.array_join(x["missing"], ","))),
            F.when(F.col("gaps") > listed, F.array(F.format_string("... %d more systems with missing files", F.col("gaps") - listed))).otherwise(F.array().cast("array<string>")),
        )),
    )
    return df.select(F.array_join(lines, "\n").alias("text"))
