"""Batch jobs over structures: named steps, errors as rows, the rest goes on.

A job takes each structure through its steps in turn. A step is a function of
the structure's state, a dictionary that starts with ``rows`` (the structure's
rows, in order) and that takes up what each step returns. A step that raises
ends its structure's job: the result row names the step and the error and keeps
what the steps before it found, and no other structure is touched.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType, _parse_datatype_string

from crystalspark.operators import cells, dims, groups

Step = Callable[[dict], dict | None]
CELL = ("a", "b", "c", "alpha", "beta", "gamma")


def run(rows: DataFrame, order: list[str], steps: list[tuple[str, Step]], results: str) -> DataFrame:
    """(structure_id, results, failed_step, error) of every structure; ``results`` names fields of the state, as a schema.

    ``rows`` are the rows of all structures (structure_id), ordered within each
    by ``order``; nulls in them reach the steps as None. A field that no step
    has set is null, and so are failed_step and error where all steps succeed.
    An empty table has no rows. Rows with a null structure_id are one structure.
    """
    key = next(f for f in rows.schema.fields if f.name == "structure_id")
    fields = _parse_datatype_string(results).fields
    schema = StructType([key, *fields, StructField("failed_step", StringType()), StructField("error", StringType())])

    def one(found):
        state: dict = {"rows": found}
        failed = error = None
        for name, step in steps:
            try:
                state |= step(state) or {}
            except Exception as problem:  # any error is the structure's own, and is reported
                failed, error = name, str(problem) or type(problem).__name__
                break
        return [{"structure_id": found[0]["structure_id"], "failed_step": failed, "error": error} | {f.name: state.get(f.name) for f in fields}]

    return cells.by_structure(rows, order, one, schema)


def failures(done: DataFrame) -> DataFrame:
    """(failed_step, error, n, example) of a job's result, the commonest first within a step."""
    bad = done.where("failed_step IS NOT NULL")
    return bad.groupBy("failed_step", "error").agg(F.count("*").alias("n"), F.min("structure_id").alias("example")).orderBy("failed_step", F.desc("n"), "error")


# steps over atoms (atom_idx, element, fx, fy, fz and the cell)


def known_elements(state: dict) -> dict:
    """Elements of the atoms; one without radius or mass is an error."""
    elements = [r["element"] for r in state["rows"]]
    for e in elements:
        if e not in dims.ELEMENTS:
            raise ValueError(f"nothing is known of element {e or '(null)'}")
    return {"elements": np.array(elements)}


def placed(state: dict) -> dict:
    """The lattice and coordinates; missing numbers and cells without a volume are errors."""
    first = state["rows"][0]
    if any(first[c] is None for c in CELL) or any(r[c] is None for r in state["rows"] for c in ("fx", "fy", "fz")):
        raise ValueError("a coordinate or cell parameter is missing")
    cell = cells.lattice_matrix(*[float(first[c]) for c in CELL])
    points = np.array([[r["fx"], r["fy"], r["fz"]] for r in state["rows"]], dtype=float)
    if not np.isfinite(points).all() or not np.isfinite(cell).all() or abs(np.linalg.det(cell)) < 1e-6:
        raise ValueError("the cell has no volume or a coordinate is not a number")
    return {"cell": cell, "points": points, "volume": float(abs(np.linalg.det(cell)))}


def organic(state: dict) -> dict:
    """Formula (carbon, hydrogen, then by name) and weight of the cell; carbon and hydrogen have to be there."""
    counts = Counter(state["elements"].tolist())
    for e, name in (("C", "carbon"), ("H", "hydrogen")):
        if not counts[e]:
            raise ValueError(f"no {name} in the cell")
    ordered = sorted(counts, key=lambda e: (e != "C", e != "H", e))
    return {"formula": " ".join(f"{e}{counts[e]}" for e in ordered), "weight": float(sum(dims.ELEMENTS[e][2] * n for e, n in counts.items()))}


def symmetric(symprec: float = 0.05) -> Step:
    """Operations found, unique atoms and the space group; two atoms of one place are an error."""

    def step(state: dict) -> dict:
        p, e, cell = state["points"], state["elements"], state["cell"]
        if len(p) != len(cells.greedy_sites(p, np.full(len(p), "X"), cell, 0.01)):
            raise ValueError("two atoms share a place")
        found, label = cells.analysed(p, e, cell, symprec)
        name = groups.identify([(r.T, t) for r, t in found], symprec / np.cbrt(state["volume"]))
        return {"n_operations": len(found), "n_unique": len(np.unique(label)), "number": name and name[0], "symbol": name and name[1]}

    return step


#: Check of full cells: what they are made of, and their symmetry.
CELL_STEPS: list[tuple[str, Step]] = [("elements", known_elements), ("cell", placed), ("composition", organic), ("symmetry", symmetric())]
CELL_RESULTS = "formula string, weight double, volume double, n_operations int, n_unique int, number int, symbol string"


def check_cells(atoms: DataFrame) -> DataFrame:
    """The check of full cells as a job, a row a structure whatever is wrong with it."""
    return run(atoms.select("structure_id", "atom_idx", "element", "fx", "fy", "fz", *CELL), ["atom_idx"], CELL_STEPS, CELL_RESULTS)
