"""Scalar text functions of crystal and log files, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"([+-]?[0-9.]+(?:[Ee][+-]?[0-9]+)?)"


def strip_quotes(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), "^['\"]+|['\"]+$", "")


def strip_uncertainty(c: Column) -> Column:
    """``1.23(4)`` becomes ``1.23``."""
    return F.trim(F.regexp_replace(c, r"\([^)]+\)", ""))


def to_float(c: Column) -> Column:
    """A number, with an uncertainty or as a fraction; null if it is neither."""
    v = strip_uncertainty(strip_quotes(c))
    parts = F.split(v, "/")
    fraction = F.try_divide(parts[0].try_cast("double"), parts[1].try_cast("double"))
    return F.when(v.rlike(r"^[+-]?\d+/\d+$"), fraction).otherwise(v.try_cast("double"))


def to_flag(c: Column, default: bool) -> Column:
    v = F.lower(F.trim(strip_quotes(c)))
    return F.when(v.isin("true", "t", "yes", "y", "1"), True).when(v.isin("false", "f", "no", "n", "0"), False).otherwise(F.lit(default))


def element_of_label(c: Column) -> Column:
    return F.regexp_extract(c, "^([A-Za-z]+)", 1)


def element_symbol(text: str, known) -> str | None:
    """The known element that the letters of a symbol or label spell, or else their first one; D and T are hydrogen."""
    v = "".join(c for c in text if c.isascii() and c.isalpha()).capitalize()
    return "H" if v in ("D", "T") else next((x for x in (v, v[:1]) if x in known), None)


def normal_element(c: Column, known) -> Column:
    """``element_symbol`` as a column."""
    v = F.initcap(F.regexp_replace(c, "[^A-Za-z]", ""))
    first = F.substring(v, 1, 1)
    return F.when(v.isin("D", "T"), "H").when(v.isin(*known), v).when(first.isin(*known), first)


def safe_name(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), r"\s+", "_")


def spaced_symbol(c: Column) -> Column:
    """``P21/c`` becomes ``P 21/c``."""
    v = F.trim(F.regexp_replace(strip_quotes(c), r"\s+", " "))
    return F.when(v.rlike(r"^[A-Za-z] "), v).otherwise(F.regexp_replace(v, "^([A-Za-z])(.+)$", "$1 $2"))


def heavy_type(element: Column) -> Column:
    """Force-field type of a heavy atom: the symbol padded to three places."""
    return F.rpad(element, 3, "_")


def hydrogen_type(parent: Column, label_type: str) -> Column:
    """Force-field type of a hydrogen by its heavy neighbour; null if unsupported."""
    if label_type == "fit_hp":
        return F.when(parent.isin("N", "O"), "H_p").when(parent.isin("C", "S"), "H_c")
    return F.when(parent.isin("C", "S"), "H_c").when(parent == "N", "H_n").when(parent == "O", "H_o")


#: Markers of failed runs and their patterns (fixed values of the log formats).
FATAL = {
    "ibzkpt_error": r"(?i)\bIBZKPT\b",
    "insufficient_memory": r"(?i)insufficient memory|out of memory|oom-kill",
    "killed": r"(?i)\bkilled\b",
    "vasp_fatal": r"(?i)VERY BAD NEWS|ZBRENT: fatal error|internal error",
    "error": r"(?im)^\s*ERROR\b",
}


def fatal_markers(c: Column) -> Column:
    """Markers found in a log, in the order above; null for no log."""
    found = F.filter(F.array(*[F.when(c.rlike(p), F.lit(k)) for k, p in FATAL.items()]), lambda x: x.isNotNull())
    return F.when(c.isNotNull(), found)


def chain_text(c: Column) -> Column:
    return F.coalesce(F.nullif(F.array_join(c, "."), F.lit("")), F.lit("0"))
