"""Numeric Z-matrix files with titles, labels and bond lists.

A file is one row throughout: its lines are an array, and every step is a
function of that array, so reading needs no shuffle and no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crystalspark.operators import dims

FIELDS = ["bond_to", "bond_length", "angle_to", "angle_deg", "dihedral_to", "dihedral_deg"]


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of text files, one row a file."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def _symbol(v: Column) -> Column:
    """The element a token with an initial capital names, D and T as hydrogen; null if it names none."""
    return F.when(v.isin("D", "T"), "H").when(v.isin(*dims.ELEMENTS), v)


def _body(comments: str, names: list[str]) -> Column:
    """What follows the colon in each comment of one of the names."""
    mine = F.filter(comments, lambda x: F.lower(F.trim(F.substring_index(x["body"], ":", 1))).isin(names) & x["body"].contains(":"))
    return F.transform(mine, lambda x: F.struct(x["line_no"].alias("line_no"), F.trim(F.regexp_extract(x["body"], r"^[^:]*:(.*)$", 1)).alias("body")))


def _words(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda x: x != "")


def _rows(words: Column) -> Column:
    """Element, label and value fields of each row's words: ``element …``, ``label element …`` or ``element label …``.

    A lambda works out a value as often as it is named, so what is used again is a field of the step before.
    """
    second = lambda x: F.get(x["words"], F.lit(1))
    capital = F.transform(words, lambda x: F.struct(x["line_no"].alias("line_no"), x["words"].alias("words"), F.initcap(x["words"][0]).alias("v"), F.initcap(second(x)).alias("w"), (F.size(x["words"]) % 2 == 1).alias("odd")))
    named = F.transform(capital, lambda x: F.struct(x["line_no"].alias("line_no"), x["words"].alias("words"), _symbol(x["v"]).alias("first"), _symbol(x["w"]).alias("second"), x["odd"].alias("odd")))
    form = lambda x: F.when(x["first"].isNotNull() & x["odd"], 1).when(x["second"].isNotNull() & ~x["odd"], 2).when(x["first"].isNotNull() & ~x["odd"] & second(x).try_cast("int").isNull(), 3)
    formed = F.transform(named, lambda x: F.struct(x["line_no"].alias("line_no"), x["words"].alias("words"), x["first"].alias("first"), x["second"].alias("second"), form(x).alias("form")))
    rest = lambda x, k: F.slice(x["words"], k, F.size(x["words"]) - k + 1)
    return F.transform(formed, lambda x: F.struct(
        x["line_no"].alias("line_no"), F.when(x["form"] == 2, x["second"]).when(x["form"].isNotNull(), x["first"]).alias("element"), F.when(x["form"] == 2, x["words"][0]).when(x["form"] == 3, second(x)).alias("label"),
        F.when(x["form"] == 1, rest(x, 2)).when(x["form"].isNotNull(), rest(x, 3)).alias("values"),
    ))


def _atom(x: Column, i: Column) -> Column:
    """A row with its label resolved: its own, that of the labels comment, or the element and its running number."""
    same = F.size(F.filter(F.slice("_rows", F.lit(1), i + 1), lambda y: y["element"] == x["element"]))
    value = lambda k: F.get(x["values"], F.lit(k)).try_cast("int" if k % 2 == 0 else "double")
    label = F.coalesce(x["label"], F.get("_labels", i), F.concat(x["element"], same.cast("string")))
    return F.struct((i + 1).alias("row_index"), x["line_no"].alias("line_no"), label.alias("label"), x["element"].alias("element"), x["values"].alias("values"), *[value(k).alias(c) for k, c in enumerate(FIELDS)])


def _complaint(x: Column) -> Column:
    """What is wrong with an atom row by itself; null if nothing is."""
    n = F.size(x["values"])
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    pairs = [(n > k) & ~(x[FIELDS[k]].isNotNull() & finite(x[FIELDS[k + 1]])) for k in (0, 2, 4)]
    expected = 2 * F.least(x["row_index"] - 1, F.lit(3))
    early = [x[c].isNotNull() & ~x[c].between(1, x["row_index"] - 1) for c in FIELDS[::2]]
    reason = (
        F.when(x["element"].isNull(), "no element").when(~n.isin(0, 2, 4, 6), "fields are not pairs").when(pairs[0] | pairs[1] | pairs[2], "reference or value is no number")
        .when(n != expected, "wrong number of references").when(early[0] | early[1] | early[2], "reference to no earlier row").when(x["bond_length"] <= 0, "length not positive")
    )
    return F.concat(F.lit("line "), x["line_no"].cast("string"), F.lit(": "), reason)


def documents(texts: DataFrame) -> DataFrame:
    """(path, mol_id, title, atoms, bonds, errors) of files (path, text), one row a file, null texts as empty ones.

    ``#`` starts a comment. Comments ``title:``, ``labels:`` or
    ``atom-labels:`` count as the last of each says, ``bonds:`` all together;
    a file without a title has its name. Bonds are unordered pairs of row
    numbers, each once. A file with errors keeps what could be read.
    """
    trimmed = F.transform(F.split(F.coalesce("text", F.lit("")), r"\r\n|\r|\n"), lambda x, i: F.struct((i + 1).alias("line_no"), F.regexp_replace(x, r"^\s+|\s+$", "").alias("line")))
    df = texts.select("path", F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("mol_id"), F.filter(trimmed, lambda x: x["line"] != "").alias("_lines"))
    said = F.transform(F.filter("_lines", lambda x: x["line"].startswith("#")), lambda x: F.struct(x["line_no"].alias("line_no"), F.regexp_replace(x["line"], r"^#\s*", "").alias("body")))
    rows = F.transform(F.filter("_lines", lambda x: ~x["line"].startswith("#")), lambda x: F.struct(x["line_no"].alias("line_no"), _words(F.substring_index(x["line"], "#", 1)).alias("words")))
    df = df.select("path", "mol_id", said.alias("_said"), _rows(rows).alias("_rows"))
    titles = F.transform(F.filter(_body("_said", ["title"]), lambda x: x["body"] != ""), lambda x: x["body"])
    bonds = F.flatten(F.transform(_body("_said", ["bonds"]), lambda x: F.transform(_words(x["body"]), lambda t: F.struct(x["line_no"].alias("line_no"), t.alias("token")))))
    df = df.select(
        "path", "mol_id", "_rows", F.coalesce(F.try_element_at(titles, F.lit(-1)), "mol_id").alias("title"), bonds.alias("_bonds"),
        _words(F.try_element_at(_body("_said", ["labels", "atom-labels"]), F.lit(-1))["body"]).alias("_labels"),
    )
    read = lambda x: F.struct(x["line_no"].alias("line_no"), x["token"].alias("token"), *[F.regexp_extract(x["token"], r"^(\d+)-(\d+)$", k).try_cast("int").alias(n) for k, n in ((1, "p"), (2, "q"))])
    df = df.withColumn("_bonds", F.transform("_bonds", read))
    good = lambda x: F.coalesce(x["p"] != x["q"], F.lit(False))
    df = df.select(
        "path", "mol_id", "title", "_labels", F.transform("_rows", _atom).alias("atoms"), F.array_sort(F.array_distinct(F.transform(F.filter("_bonds", good), lambda x: F.struct(F.least(x["p"], x["q"]).alias("i"), F.greatest(x["p"], x["q"]).alias("j"))))).alias("bonds"),
        F.transform(F.filter("_bonds", lambda x: ~good(x)), lambda x: F.concat(F.lit("line "), x["line_no"].cast("string"), F.lit(": no bond "), x["token"])).alias("_unread"),
    )
    names = F.transform("atoms", lambda x: x["label"])
    whole = F.array(
        F.when(F.size("atoms") == 0, "no atom rows"), F.when(F.size("_labels") != F.size("atoms"), "labels and rows differ in number"),
        F.when(F.size(F.array_distinct(names)) < F.size("atoms"), "labels are not unique"),
    )
    errors = F.filter(F.concat(whole, F.transform("atoms", _complaint), "_unread"), lambda x: x.isNotNull())
    plain = F.transform("atoms", lambda x: x.dropFields("values"))
    return df.select("path", "mol_id", "title", plain.alias("atoms"), "bonds", errors.alias("errors"))


def _rows_of(found: DataFrame, name: str) -> DataFrame:
    """Elements of an array of the files without errors; a filter on the errors would be pushed below the steps that make them, each then worked out as often as it is named."""
    return found.select("mol_id", F.inline(F.when(F.size("errors") == 0, F.col(name))))


def atom_rows(found: DataFrame) -> DataFrame:
    """Rows of the files without errors, one an atom."""
    return _rows_of(found, "atoms")


def bond_rows(found: DataFrame) -> DataFrame:
    """(mol_id, i, j) of the bonds that files without errors list."""
    return _rows_of(found, "bonds")


def matched(molecules: DataFrame, rows: DataFrame) -> DataFrame:
    """Atoms in the order of a Z-matrix: (structure_id, component, mol_id, row_index, atom_idx), null from mol_id on where none fits.

    ``molecules`` are atoms (structure_id, component, atom_idx, label), ``rows``
    those of Z-matrices (mol_id, row_index, label). A molecule takes the first
    Z-matrix, by ``mol_id``, that has the same set of labels.
    """
    labels = F.array_sort(F.collect_set("label")).alias("labels")
    kinds = rows.groupBy("mol_id").agg(labels).groupBy("labels").agg(F.min("mol_id").alias("mol_id"))
    chosen = molecules.groupBy("structure_id", "component").agg(labels).join(kinds, "labels", "left").drop("labels")
    placed = chosen.join(rows.select("mol_id", "row_index", "label"), "mol_id", "left")
    return placed.join(molecules.select("structure_id", "component", "label", "atom_idx"), ["structure_id", "component", "label"], "left").select("structure_id", "component", "mol_id", "row_index", "atom_idx")
