"""Result tables of simulation campaigns: their points, merges and pairings, why a system was left out, and counts of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from crystalspark.operators import calculations as c

#: Columns that may name a row's system, the first with a value counts (fixed values).
NAMES = ["identifier", "Identifier", "name"]
#: What becomes of outliers: two tables, left out, kept with a mark, kept as any other row.
OUTLIERS = ("separate", "drop", "mark", "keep")


def identifier(df: DataFrame, names: list[str] = NAMES) -> Column:
    """The first of the columns that is there, spelt just so, and not blank."""
    there = [F.nullif(F.trim(F.col(f"`{n}`").cast("string")), F.lit("")) for n in names if n in df.columns]
    if not there:
        raise ValueError(f"none of the columns {', '.join(names)}")
    return F.coalesce(*there)


def points(df: DataFrame, x: str, y: str, hydrate: str = "hydrate", exact: str | None = None) -> DataFrame:
    """(identifier, x, y, is_hydrate) of rows whose x and y are finite numbers.

    The hydrate flag is TRUE in any case, or just the text ``exact``; a table
    without the column has no hydrates.
    """
    flag = F.lit(None).cast("string") if hydrate not in df.columns else F.trim(F.col(hydrate).cast("string"))
    yes = F.upper(flag) == "TRUE" if exact is None else flag == exact
    out = df.select(identifier(df).alias("identifier"), *[F.trim(F.col(v).cast("string")).try_cast("double").alias(k) for k, v in (("x", x), ("y", y))], F.coalesce(yes, F.lit(False)).alias("is_hydrate"))
    finite = lambda v: F.col(v).isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    return out.where(finite("x") & finite("y"))


def outliers(df: DataFrame, named: list[str] | Column, keep: str = "separate") -> tuple[DataFrame, DataFrame]:
    """The rows to plot and the removed ones, for identifiers (or a condition) and one of ``OUTLIERS``; ``mark`` adds ``is_outlier``."""
    if keep not in OUTLIERS:
        raise ValueError(f"{keep} is none of {', '.join(OUTLIERS)}")
    out = F.coalesce(named if isinstance(named, Column) else F.col("identifier").isin(named), F.lit(False))
    if keep in ("mark", "keep"):
        return (df.withColumn("is_outlier", out) if keep == "mark" else df), df.where(F.lit(False))
    return df.where(~out), df.where(out) if keep == "separate" else df.where(F.lit(False))


def merged(first: DataFrame, second: DataFrame, on: str) -> DataFrame:
    """Rows of either source by key, values of the second before those of the first, with ``in_first`` and ``in_second``."""
    values = [x for x in dict.fromkeys([*first.columns, *second.columns]) if x != on]
    sides = [df.select(on, *[F.col(x).alias(f"_{k}{x}") for x in df.columns if x != on], F.lit(True).alias(f"_in{k}")) for k, df in enumerate((first, second))]
    pick = lambda x: F.coalesce(*[F.col(f"_{k}{x}") for k, df in ((1, second), (0, first)) if x in df.columns]).alias(x)
    there = [F.coalesce(f"_in{k}", F.lit(False)).alias(n) for k, n in enumerate(("in_first", "in_second"))]
    return sides[0].join(sides[1], on, "full_outer").select(on, *map(pick, values), *there)


def paired(left: DataFrame, right: DataFrame, on: str, strict: bool = False) -> DataFrame:
    """(key, state) of the keys of two tables: ``paired``, ``missing left`` or ``missing right``. With ``strict`` reading a key that is missing raises."""
    a, b = (df.select(on).distinct().withColumn(f"_{k}", F.lit(True)) for k, df in enumerate((left, right)))
    state = F.when(F.col("_0").isNull(), "missing left").when(F.col("_1").isNull(), "missing right").otherwise("paired")
    df = a.join(b, on, "full_outer").select(on, state.alias("state"))
    if strict:
        fail = F.raise_error(F.concat_ws(" ", "state", F.col(on).cast("string"))).cast("string")
        df = df.withColumn("state", F.when(F.col("state") == "paired", F.col("state")).otherwise(fail))
    return df


def reason(rules: dict[str, Column], otherwise: str) -> Column:
    """The first rule that holds, in the order given; a null condition doesn't."""
    out = None
    for name, condition in rules.items():
        out = F.when(condition, name) if out is None else out.when(condition, name)
    return F.lit(otherwise) if out is None else out.otherwise(otherwise)


def campaign_reasons(systems: DataFrame, special: list[str] = ()) -> DataFrame:
    """Adds ``reason`` to systems (system, energy, notes, contcar, poscar, signature, expected_signature): why no input is made, or ``generated``."""
    blank = F.coalesce(F.trim("notes"), F.lit("")) == ""
    return systems.withColumn("reason", reason({
        "invalid energy": F.col("energy").try_cast("double").isNull() | F.isnan(F.col("energy").try_cast("double")),
        "notes present": ~blank, "special positions": F.col("system").isin(list(special)), "no CONTCAR": F.col("contcar").isNull(), "no POSCAR": F.col("poscar").isNull(),
        "signature differs": ~F.col("signature").eqNullSafe(F.col("expected_signature")),
    }, "generated"))


def highlighted(df: DataFrame, chosen: DataFrame, on: str = "identifier") -> DataFrame:
    """Rows whose key is among the chosen ones."""
    return df.join(chosen.select(on).distinct(), on, "left_semi")


def with_start(systems: DataFrame, files: DataFrame, name: str = "POSCAR") -> DataFrame:
    """Adds ``start_path`` to systems: the file of that name in the system's own folder (``files`` as ``manifest`` lists them), null if there is none."""
    start = files.where((F.col("filename") == name) & (F.size("chain") == 0)).groupBy("system").agg(F.min("path").alias("start_path"))
    return systems.join(start, "system", "left")


def status_counts(df: DataFrame, expected: list[str], status: str = "status") -> DataFrame:
    """(status, n): rows of each state, with zeros for expected ones that don't occur; null counts as ``unknown``."""
    wanted = df.sparkSession.createDataFrame([(e,) for e in expected], "status string")
    have = df.groupBy(F.coalesce(F.col(status), F.lit("unknown")).alias("status")).agg(F.count("*").alias("_n"))
    return wanted.join(have, "status", "full_outer").select("status", F.coalesce("_n", F.lit(0)).alias("n"))


def distribution(df: DataFrame, value: str) -> DataFrame:
    """(value, n, share) of a column's values, null among them."""
    counts = df.groupBy(F.col(value).alias("value")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy()))  # one row a value


def runs(spark: SparkSession, root: str, name: str = "vasprun.xml") -> DataFrame:
    """(system, relative_path, path, text) of the files of that name at any depth below the folders of ``root``, which are the systems."""
    files = spark.read.option("pathGlobFilter", name).option("recursiveFileLookup", True).text(root, wholetext=True)
    path, below = F.col("_metadata.file_path"), root.rstrip("/") + "/"
    parts = F.split(F.substring(path, F.instr(path, below) + len(below), F.length(path)), "/")
    df = files.select(path.alias("path"), parts.alias("_parts"), F.col("value").alias("text")).where(F.size("_parts") > 1)
    return df.select(F.col("_parts")[0].alias("system"), F.array_join(F.slice("_parts", F.lit(2), F.size("_parts") - 1), "/").alias("relative_path"), "path", "text")


def system_summary(runs: DataFrame) -> DataFrame:
    """A row a calculation, for runs (system, relative_path, text) of whole XML outputs.

    ``relative_path`` lies under the system's folder, and its folders are
    numbers: runs follow each other by depth, then by these. Adds the columns
    of ``calculation_xml``, ``position`` from 1, ``calculation_count`` and
    ``is_latest_calculation``. A run whose folders are not all numbers has
    ``chain_error``, comes first and is never the latest beside one that has none.
    """
    chain = c.numeric_chain(F.col("relative_path"))
    df = runs.withColumns({"calculation_chain": chain} | c.calculation_xml(F.col("text"))).drop("text")
    df = df.withColumn("chain_error", F.when(F.col("calculation_chain").isNull(), F.lit("a folder of the chain is no number")))
    mine = W.partitionBy("system")
    order = mine.orderBy(F.col("calculation_chain").isNotNull(), F.size("calculation_chain"), "calculation_chain", "relative_path")
    df = df.withColumns({"position": F.row_number().over(order), "calculation_count": F.count("*").over(mine)})
    return df.withColumn("is_latest_calculation", F.col("position") == F.col("calculation_count"))


def manifest_table(entries: DataFrame) -> DataFrame:
    """The columns of a manifest file, chains as text (``.`` for the system's own folder), in order of system and path."""
    chain = F.when(F.size("chain") > 0, F.array_join("chain", "/")).otherwise(".")
    return entries.select(
        F.col("system").alias("system_name"), chain.alias("calculation_chain"), "filename", "relative_path", "size_bytes", F.col("path").alias("absolute_path"),
    ).orderBy("system_name", "relative_path")


def write_table(df: DataFrame, path: str) -> None:
    """As CSV files with a header, by Spark's committer."""
    df.write.mode("errorifexists").option("header", True).csv(path)


def markdown(df: DataFrame, order: list[str], title: str = "") -> DataFrame:
    """One row, ``text``: a report table (counts, a row a structure at most) as Markdown. The whole text is one value: for reports of bounded size."""
    cell = lambda x: F.replace(F.coalesce(F.col(x).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|"))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(x) for x in df.columns]), F.lit(" |"))
    head = [f"## {title}\n"] * bool(title) + ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    rows = F.transform(F.array_sort(F.collect_list(F.struct(*order, line.alias("_line")))), lambda x: x["_line"])
    return df.agg(F.array_join(F.concat(F.array(*[F.lit(h) for h in head]), rows), "\n").alias("text"))
