"""Internal coordinates: reading, checking, measuring, classifying and rebuilding."""

from __future__ import annotations

import heapq
from hashlib import blake2b
from itertools import combinations, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crystalspark.functions import geometry as g
from crystalspark.operators import batches
from crystalspark.operators.dims import ELEMENTS

SCHEMA = "mol_id string, row_index int, element string, bond_to int, bond_length double, angle_to int, angle_deg double, dihedral_to int, dihedral_deg double"

#: Rows of molecules that are rebuilt in one step, at most (a larger molecule is a step of its own).
STEP = 200_000


def perpendicular(v: np.ndarray) -> np.ndarray:
    axis = np.array([1.0, 0, 0]) if abs(v[0]) < 0.8 else np.array([0, 1.0, 0])
    w = np.cross(v, axis)
    return w / np.linalg.norm(w)


def place(origin: np.ndarray, second: np.ndarray, third: np.ndarray, length: float, theta: float, phi: float) -> np.ndarray:
    """The point at ``length`` from origin, ``theta`` from second and ``phi`` about the axis from third (radians)."""
    axis = (second - origin) / np.linalg.norm(second - origin)
    across = third - second
    across = across - axis * (across @ axis)
    across = perpendicular(axis) if np.linalg.norm(across) < 1e-10 else across / np.linalg.norm(across)
    side = np.cross(axis, across)
    return origin + length * (axis * np.cos(theta) + (across * np.cos(phi) - side * np.sin(phi)) * np.sin(theta))


def rebuild(rows: list[tuple]) -> np.ndarray:
    """Cartesian points of (bond_to, length, angle_to, degrees, dihedral_to, degrees) rows with 1-based references."""
    out = np.zeros((len(rows), 3))
    for i, (b, r, a, theta, d, phi) in enumerate(rows):
        b, a, d = (int(x) if x is not None and x == x else 0 for x in (b, a, d))
        if i == 1:
            out[1] = out[b - 1] + [r, 0, 0]
        elif i == 2:
            axis = out[a - 1] - out[b - 1]
            axis = axis / np.linalg.norm(axis)
            out[2] = out[b - 1] + r * (axis * np.cos(np.radians(theta)) + perpendicular(axis) * np.sin(np.radians(theta)))
        elif i > 2:
            out[i] = place(out[b - 1], out[a - 1], out[d - 1], r, np.radians(theta), np.radians(phi))
    return out


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def perpendiculars(v: np.ndarray) -> np.ndarray:
    """``perpendicular`` of each row."""
    return unit(np.cross(v, np.where((np.abs(v[:, 0]) < 0.8)[:, None], [1.0, 0, 0], [0, 1.0, 0])))


def rebuild_many(offsets: np.ndarray, references: np.ndarray, values: np.ndarray) -> np.ndarray:
    """``rebuild`` of many molecules, whose rows lie one after another: the n-th rows of all are placed at once.

    References are (bond_to, angle_to, dihedral_to), 0 for none; values are
    (length, degrees, degrees).
    """
    out, sizes = np.zeros((len(values), 3)), np.diff(offsets)
    order = np.argsort(-sizes, kind="stable")
    heads, sizes = offsets[order], sizes[order]
    length, theta, phi = values[:, 0], np.radians(values[:, 1]), np.radians(values[:, 2])
    for i in range(1, int(sizes[0]) if len(sizes) else 0):
        n = int(np.searchsorted(-sizes, -i))  # molecules with more than i rows
        at, size = heads[:n] + i, sizes[:n]
        ref = references[at, : min(i, 3)] - 1
        if (ref >= size[:, None]).any() or (ref < -size[:, None]).any():
            raise IndexError("reference to a row that is not there")
        points = [out[heads[:n] + r] for r in (ref % size[:, None]).T]
        r, t = length[at, None], theta[at, None]
        if i == 1:
            out[at] = points[0]
            out[at, 0] += length[at]
            continue
        axis = unit(points[1] - points[0])
        if i == 2:
            out[at] = points[0] + r * (axis * np.cos(t) + perpendiculars(axis) * np.sin(t))
            continue
        across = points[2] - points[1]
        across = across - axis * np.einsum("ij,ij->i", across, axis)[:, None]
        size = np.sqrt(np.einsum("ij,ij->i", across, across))[:, None]
        across = np.where(size < 1e-10, perpendiculars(axis), across / size)
        side, f = np.cross(axis, across), phi[at, None]
        out[at] = points[0] + r * (axis * np.cos(t) + (across * np.cos(f) - side * np.sin(f)) * np.sin(t))
    return out


def cartesian(rows: DataFrame) -> DataFrame:
    """(mol_id, row_index, element, x, y, z) of Z-matrix rows; the molecules of a batch are rebuilt together, row by row."""
    names = ["bond_to", "angle_to", "dihedral_to", "bond_length", "angle_deg", "dihedral_deg"]
    lists = rows.groupBy("mol_id").agg(F.array_sort(F.collect_list(F.struct("row_index", "element", *names))).alias("rows"))

    def run(record_batches):
        for whole in record_batches:
            for lo, hi in batches.blocks(np.diff(whole.column("rows").offsets.to_numpy()), STEP):
                batch = whole.slice(lo, hi - lo)
                offsets = batch.column("rows").offsets.to_numpy()
                flat = batch.column("rows").values.slice(offsets[0], offsets[-1] - offsets[0])
                fields = dict(zip([f.name for f in flat.type], flat.flatten()))
                numbers = np.stack([fields[c].to_numpy(zero_copy_only=False).astype(float) for c in names], axis=1)
                with np.errstate(invalid="ignore", divide="ignore"):
                    points = rebuild_many(offsets - offsets[0], np.nan_to_num(numbers[:, :3]).astype(int), numbers[:, 3:])
                ids = batch.column("mol_id").take(pa.array(np.repeat(np.arange(len(batch)), np.diff(offsets))))
                yield pa.RecordBatch.from_arrays([ids, fields["row_index"], fields["element"], *[pa.array(points[:, c]) for c in range(3)]], names=["mol_id", "row_index", "element", "x", "y", "z"])

    return lists.mapInArrow(run, "mol_id string, row_index int, element string, x double, y double, z double")


def faults(c) -> Column:
    """What is wrong with a row whose columns are ``c(name)``: reference counts by row, references to earlier rows, positive lengths, finite values."""
    i = c("row_index")
    bond, angle, turn = c("bond_to"), c("angle_to"), c("dihedral_to")
    given = sum(x.isNotNull().cast("int") for x in (bond, angle, turn))
    checks = [
        F.when(given != F.least(i - 1, F.lit(3)), "wrong number of references"),
        F.when((bond >= i) | (angle >= i) | (turn >= i) | (F.least(bond, angle, turn) < 1), "reference to a later row"),
        F.when((bond == angle) | (bond == turn) | (angle == turn), "repeated reference"),
        F.when(c("bond_length") <= 0, "length not positive"),
        F.when(F.isnan(c("bond_length")) | F.isnan(c("angle_deg")) | F.isnan(c("dihedral_deg")), "value not finite"),
    ]
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


def problems(rows: DataFrame) -> DataFrame:
    """Adds ``errors``, the ``faults`` of each row."""
    return rows.withColumn("errors", faults(F.col))


def kind_of(bond: int, angle: int, turn: int, links: set[tuple[int, int]]) -> str:
    """The kind of a dihedral by the bonds (both ways round) along its references, as of ``dihedral_kinds``."""
    first, chain, star = (bond, angle) in links, (angle, turn) in links, (bond, turn) in links
    return "fallback" if not first or not (chain or star) else "ambiguous" if chain and star else "proper" if chain else "improper"


def dihedral_kinds(rows: DataFrame, bonds: DataFrame) -> DataFrame:
    """Adds ``kind`` by the bonds (mol_id, a, b; a before b, 1-based) along a row's references: proper, improper, ambiguous or fallback."""
    def linked(df: DataFrame, p: str, q: str, name: str) -> DataFrame:
        keyed = bonds.select(F.col("mol_id").alias(f"_{name}m"), F.col("a").alias(f"_{name}a"), F.col("b").alias(f"_{name}b"), F.lit(True).alias(name))
        return df.join(keyed, (F.col("mol_id") == F.col(f"_{name}m")) & (F.least(p, q) == F.col(f"_{name}a")) & (F.greatest(p, q) == F.col(f"_{name}b")), "left").drop(f"_{name}m", f"_{name}a", f"_{name}b")

    df = rows.where("dihedral_to IS NOT NULL")
    df = linked(linked(linked(df, "bond_to", "angle_to", "_ba"), "angle_to", "dihedral_to", "_ad"), "bond_to", "dihedral_to", "_bd")
    chain, star = F.coalesce("_ba", F.lit(False)) & F.coalesce("_ad", F.lit(False)), F.coalesce("_ba", F.lit(False)) & F.coalesce("_bd", F.lit(False))
    kind = F.when(chain & star, "ambiguous").when(chain, "proper").when(star, "improper").otherwise("fallback")
    return df.withColumn("kind", kind).drop("_ba", "_ad", "_bd")


def measures(rows: DataFrame, points: DataFrame) -> DataFrame:
    """The rows with ``m_bond_length``, ``m_angle_deg`` and ``m_dihedral_deg``, measured on points (mol_id, row_index, x, y, z).

    A molecule's rows and points meet once, and references are looked up in
    the list of its points: by place where it has every row from the first on.
    """
    whole = F.forall(F.transform("points", lambda p, i: p["row_index"] == i + 1), lambda x: x)
    lists = points.groupBy("mol_id").agg(F.array_sort(F.collect_list(F.struct("row_index", "x", "y", "z"))).alias("points")).withColumn("whole", whole)
    own = rows.groupBy("mol_id").agg(F.collect_list(F.struct(*[c for c in rows.columns if c != "mol_id"])).alias("rows"))

    def found(ref):
        return F.when(F.col("whole"), F.when(ref > 0, F.get("points", ref - 1))).otherwise(F.get(F.filter("points", lambda p: p["row_index"] == ref), 0))

    ends = {"o": "row_index", "b": "bond_to", "a": "angle_to", "d": "dihedral_to"}
    met = own.join(lists, "mol_id", "left").select("mol_id", F.explode(F.transform("rows", lambda r: F.struct(r.alias("r"), *[found(r[c]).alias(n) for n, c in ends.items()]))).alias("m"))
    o, b, a, d = (tuple(F.col(f"m.{n}.{c}") for c in "xyz") for n in ends)
    values = {"bond_length": g.norm(g.minus(o, b)), "angle_deg": g.angle(o, b, a), "dihedral_deg": g.dihedral(o, b, a, d)}
    return met.select("mol_id", *[F.col(f"m.r.{c}").alias(c) for c in rows.columns if c != "mol_id"], *[v.alias(f"m_{c}") for c, v in values.items()])


def measured(rows: DataFrame, points: DataFrame) -> DataFrame:
    """The rows with lengths, angles and dihedrals measured on points (mol_id, row_index, x, y, z)."""
    given = measures(rows.select("mol_id", "row_index", "element", "bond_to", "angle_to", "dihedral_to"), points)
    return given.select("mol_id", "row_index", "element", "bond_to", F.col("m_bond_length").alias("bond_length"), "angle_to", F.col("m_angle_deg").alias("angle_deg"), "dihedral_to", F.col("m_dihedral_deg").alias("dihedral_deg"))


def neighbours(n: int, links: set[tuple[int, int]]) -> list[set[int]]:
    near: list[set[int]] = [set() for _ in range(n)]
    for i, j in links:
        near[i].add(j)
        near[j].add(i)
    return near


def bend(points: np.ndarray, i: int, j: int, k: int) -> float:
    u, v = points[i] - points[j], points[k] - points[j]
    s = np.linalg.norm(u) * np.linalg.norm(v)
    return float(np.degrees(np.arccos(np.clip(u @ v / s, -1, 1)))) if s > 1e-12 else float("nan")


def margin(points: np.ndarray, i: int, j: int, k: int) -> float:
    """Degrees between the angle and a straight line or a fold; -1 if there is no angle."""
    x = bend(points, i, j, k)
    return -1.0 if np.isnan(x) else min(x, 180 - x)


def spanning_tree(elements: list[str], near: list[set[int]], points: np.ndarray) -> dict[int, int | None]:
    """Parents of the atoms, in the order in which atoms are reached.

    Heavy atoms are taken best first from the best of them: by element, number
    of bonds, distance to the centroid, index. Then every atom taken adds its
    other neighbours by index. An atom's parent is the first that reached it.
    """
    away = np.linalg.norm(points - points.mean(axis=0), axis=1)
    kind = [ELEMENTS.get(e, (0, 0, 0, 7))[3] for e in elements]
    members = {i for i, e in enumerate(elements) if e != "H"} or set(range(len(elements)))
    root = min(members, key=lambda i: (kind[i], away[i], i))
    found, order, heap = {root: None}, [], [(kind[root], 0, 0.0, root)]
    while heap:
        i = heapq.heappop(heap)[-1]
        order.append(i)
        for k in (near[i] & members) - found.keys():
            found[k] = i
            heapq.heappush(heap, (kind[k], -len(near[k]), away[k], k))
    for i in order:  # grows while it is walked
        for k in sorted(near[i] - found.keys()):
            found[k] = i
            order.append(k)
    return {i: found[i] for i in order}


def arranged(parent: dict[int, int | None], elements: list[str]) -> tuple[list[int], dict[int, int]]:
    """The tree's atoms, each followed by its branches, and the branch kept first at every fork.

    The kept branch is heavy if one is, then the largest, then the earliest;
    hydrogens follow it, then the other branches from the smallest.
    """
    place, size = {i: p for p, i in enumerate(parent)}, dict.fromkeys(parent, 1)
    branches: dict[int, list[int]] = {i: [] for i in parent}
    for i in reversed(list(parent)):
        if parent[i] is not None:
            size[parent[i]] += size[i]
            branches[parent[i]].append(i)
    kept = {i: max(b, key=lambda k: (elements[k] != "H", size[k], -place[k])) for i, b in branches.items() if len(b) > 1}
    order, stack = [], [next(iter(parent))]
    while stack:
        i = stack.pop()
        order.append(i)
        stack += sorted(branches[i], key=lambda k: (k != kept.get(i), elements[k] != "H", size[k], place[k]), reverse=True)
    return order, kept


def references(elements: list[str], near: list[set[int]], points: np.ndarray, threshold: float = 15.0) -> tuple[list[tuple], list[str]]:
    """(atom, bonded, angle and dihedral reference) by atom index for each row, and warnings.

    At a fork, rows after the kept branch refer to the fork's own neighbours
    (an improper dihedral); other rows follow bonds, and only if none gives an
    angle, atoms that are not bonded.
    """
    parent = spanning_tree(elements, near, points)
    order, kept = arranged(parent, elements)
    apart = lambda i, k: float(np.linalg.norm(points[i] - points[k]))
    rows: list[tuple] = []
    warnings: list[str] = []
    done: set[int] = set()

    def ranked(some: set[int], centre: int) -> list[int]:
        return sorted(some, key=lambda k: (elements[k] == "H", -len(near[k]), apart(k, centre), k))

    def chosen(bonded: list[int], others: list[int], score) -> tuple[int, bool]:
        scores = [score(k) for k in bonded]
        if scores and max(scores) > -1:
            return bonded[scores.index(max(scores))], True
        good = next((k for k in others if score(k) >= threshold), None)
        return (good if good is not None else max(others or bonded, key=score)), False

    def fork(i: int, b: int) -> tuple[int, int] | None:
        first = kept.get(b)
        if first is None or first == i or first not in done:
            return None
        lead = [k for k in (parent[b], first) if k is not None and k in done]
        rest = sorted((near[b] & done) - {i, *lead}, key=lambda k: (elements[k] == "H", apart(k, b), k))
        pairs = list(combinations(lead + rest, 2))
        return max(pairs, key=lambda p: (p[1] not in near[p[0]], margin(points, i, b, p[0]), margin(points, b, *p))) if pairs else None

    for step, i in enumerate(order):
        b, a, d = parent[i], None, None
        if step > 2:
            a, d = fork(i, b) or (None, None)
        if step > 1:
            if a is None:
                up = [parent[b]] if parent[b] in done else []
                bonded = up + ranked((near[b] & done) - {i, *up}, b)
                a, along = chosen(bonded, ranked(done - {b, *bonded}, b), lambda k: margin(points, i, b, k))
                if not along:
                    warnings.append(f"row {step + 1}: angle to an atom that is not bonded")
            if margin(points, i, b, a) < threshold:
                warnings.append(f"row {step + 1}: nearly straight angle")
        if step > 2:
            if d is None:
                up = [parent[a]] if parent[a] in done - {b} else []
                bonded = up + ranked((near[a] & done) - {b, *up}, a)
                left = done - {a, b, *bonded}
                d, along = chosen(bonded, ranked((left - near[b]) or left, a), lambda k: margin(points, b, a, k))
                if not along:
                    warnings.append(f"row {step + 1}: dihedral to an atom that is not bonded")
            if margin(points, b, a, d) < threshold:
                warnings.append(f"row {step + 1}: nearly straight dihedral anchor")
        rows.append((i, b, a, d))
        done.add(i)
    return rows, warnings


def numbered(template: list[tuple], elements: list[str], points: np.ndarray) -> list[tuple]:
    """Z-matrix rows (element, references and values; 1-based) of a template's references on points."""
    place = {r[0]: p + 1 for p, r in enumerate(template)}
    out = []
    for i, b, a, d in template:
        row: tuple = (elements[i],)
        if b is not None:
            row += (place[b], float(np.linalg.norm(points[i] - points[b])))
        if a is not None:
            row += (place[a], bend(points, i, b, a))
        if d is not None:
            row += (place[d], signed(points[i], points[b], points[a], points[d]))
        out.append(row)
    return out


def generate(elements: list[str], bonds: set[tuple[int, int]], points: np.ndarray, threshold: float = 15.0) -> tuple[list[tuple], list[str]]:
    """Z-matrix rows (element, refs and values; 1-based) of one connected molecule, and warnings."""
    template, warnings = references(elements, neighbours(len(elements), bonds), points, threshold)
    return numbered(template, elements, points), warnings


def refined(elements: list[str], near: list[set[int]], rounds: int = 4) -> list[str]:
    """Atom labels that agree for atoms alike in element and surroundings, whatever the order of atoms."""
    label = [f"{e}{len(k)}" for e, k in zip(elements, near)]
    for _ in range(rounds):
        label = [blake2b(repr((label[i], sorted(label[k] for k in near[i]))).encode(), digest_size=8).hexdigest() for i in range(len(label))]
    return label


def isomorphism(first: list[str], near: list[set[int]], second: list[str], other: list[set[int]]) -> list[int] | None:
    """For each atom of the first molecule its match in the second, elements and bonds alike; None if there is none.

    Atoms are matched along bonds, so that a partial match is connected;
    refined labels leave few choices to go back on.
    """
    n = len(first)
    a, b = refined(first, near), refined(second, other)
    if n != len(second) or sorted(a) != sorted(b):
        return None
    order: list[int] = []
    seen: set[int] = set()
    for start in sorted(range(n), key=lambda i: (a.count(a[i]), i)):
        queue = [start] if start not in seen else []
        while queue:
            i = queue.pop(0)
            if i not in seen:
                seen.add(i)
                order.append(i)
                queue += sorted(near[i] - seen)
    match: dict[int, int] = {}

    def options(i: int):
        anchors = [match[k] for k in near[i] if k in match]
        pool = set.intersection(*[other[k] for k in anchors]) if anchors else set(range(n))
        taken = set(match.values())
        return iter(sorted(k for k in pool - taken if b[k] == a[i] and len(other[k] & taken) == len(anchors)))

    stack = [options(order[0])] if order else []
    while stack:
        i = order[len(stack) - 1]
        match.pop(i, None)
        k = next(stack[-1], None)
        if k is None:
            stack.pop()
            continue
        match[i] = k
        if len(stack) == n:
            return [match[j] for j in range(n)]
        stack.append(options(order[len(stack)]))
    return None if n else []


def signed(i: np.ndarray, j: np.ndarray, k: np.ndarray, m: np.ndarray) -> float:
    axis = (k - j) / np.linalg.norm(k - j)
    v = (i - j) - ((i - j) @ axis) * axis
    w = (m - k) - ((m - k) @ axis) * axis
    return float(np.degrees(np.arctan2(np.cross(axis, v) @ w, v @ w)))


def generate_all(points: DataFrame, bonds: DataFrame) -> DataFrame:
    """Z-matrix rows and warnings of every molecule (structure_id, component) of unwrapped points.

    Molecules of a structure that match an earlier one take over its
    references through the match, so their rows line up; ``atom_idx`` names
    the atom of each row.
    """
    rows = points.groupBy("structure_id").agg(F.array_sort(F.collect_list(F.struct("component", "atom_idx", "element", "x", "y", "z"))).alias("atoms"))
    edges = bonds.groupBy("structure_id").agg(F.collect_list(F.struct("i", "j")).alias("links"))
    return generate_rows(rows.join(edges, "structure_id", "left"))


def lined_up(structure_atoms: list[dict], links: list[dict] | None):
    """Z-matrix rows (component, row_index, atom_idx, element, references and values, warnings) of a structure's molecules, whose atoms lie together."""
    models: dict[tuple, list[tuple]] = {}
    pairs = [(e["i"], e["j"]) for e in links or ()]
    for component, group in groupby(structure_atoms, key=lambda p: p["component"]):
        atoms = list(group)
        elements = [p["element"] for p in atoms]
        if len(atoms) == 1:
            yield (component, 1, atoms[0]["atom_idx"], elements[0], *[None] * 6, [])
            continue
        at = {p["atom_idx"]: k for k, p in enumerate(atoms)}
        near = neighbours(len(atoms), {(at[i], at[j]) for i, j in pairs if i in at and j in at})
        xyz = np.array([[p["x"], p["y"], p["z"]] for p in atoms])
        alike = models.setdefault(tuple(sorted((e, len(k)) for e, k in zip(elements, near))), [])  # only these can match
        matched = ((m, isomorphism(m[0], m[1], elements, near)) for m in alike)
        model, match = next(((m, f) for m, f in matched if f is not None), (None, None))
        if model is None:
            model, match = (elements, near, *references(elements, near, xyz)), list(range(len(atoms)))
            alike.append(model)
        template = [tuple(None if k is None else match[k] for k in r) for r in model[2]]
        for k, (row, ref) in enumerate(zip(numbered(template, elements, xyz), template)):
            yield (component, k + 1, atoms[ref[0]]["atom_idx"], *row, *[None] * (7 - len(row)), model[3])


#: The fields of a row that ``lined_up`` makes.
ROW = {"component": "int", "row_index": "int", "atom_idx": "int", "element": "string", "bond_to": "int", "bond_length": "double", "angle_to": "int", "angle_deg": "double", "dihedral_to": "int", "dihedral_deg": "double", "warnings": "array<string>"}
ARROW = {"int": pa.int32(), "double": pa.float64(), "string": pa.string(), "array<string>": pa.list_(pa.string())}


def generate_rows(rows: DataFrame) -> DataFrame:
    """``generate_all`` of structures as one row each, with ``atoms`` (component, atom_idx, element, x, y, z; a molecule's lie together) and ``links`` (i, j)."""

    def run(record_batches):
        for whole in record_batches:
            for lo, hi in batches.blocks(np.diff(whole.column("atoms").offsets.to_numpy()), STEP):
                batch, made, of = whole.slice(lo, hi - lo), [], []
                for place, (atoms, links) in enumerate(zip(batch.column("atoms").to_pylist(), batch.column("links").to_pylist())):
                    made += lined_up(atoms, links)
                    of += [place] * (len(made) - len(of))
                columns = list(zip(*made)) or [()] * len(ROW)
                arrays = [pa.array(c, ARROW[kind]) for c, kind in zip(columns, ROW.values())]
                yield pa.RecordBatch.from_arrays([batch.column("structure_id").take(pa.array(of, pa.int64())), *arrays], names=["structure_id", *ROW])

    kind = dict(rows.dtypes)["structure_id"]
    return rows.select("structure_id", "atoms", "links").mapInArrow(run, ", ".join([f"structure_id {kind}", *[f"{n} {k}" for n, k in ROW.items()]]))


def viewer_payload(rows: DataFrame, points: DataFrame) -> DataFrame:
    """(mol_id, payload): one JSON document a molecule with its atoms and dihedrals; ``<`` is escaped for embedding in HTML."""
    atoms = points.groupBy("mol_id").agg(F.array_sort(F.collect_list(F.struct("row_index", "element", "x", "y", "z"))).alias("atoms"))
    turns = rows.where("dihedral_to IS NOT NULL").groupBy("mol_id").agg(F.array_sort(F.collect_list(F.struct("row_index", "bond_to", "angle_to", "dihedral_to", "dihedral_deg"))).alias("dihedrals"))
    return atoms.join(turns, "mol_id", "left").select("mol_id", F.replace(F.to_json(F.struct("atoms", "dihedrals")), F.lit("<"), F.lit("\\u003c")).alias("payload"))
