"""Bonds and molecules of many structures at once.

A structure's atoms travel as one row, many rows to an Arrow batch; there they
lie in flat arrays, structure after structure, and no step but the few walks
that depend on order loops over atoms. What follows from the bonds of a
structure is worked out in the same task, so it costs no further shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crystalspark.functions import geometry as g
from crystalspark.operators import batches, dims

#: Width in Angstrom that the boxes of the neighbour search aim at: well beyond a bond, and small cells stay one box.
BOX = 6.0
#: Atoms that a step takes at a time (a larger structure is a step of its own).
STEP = 100_000


class Atoms:
    """The atoms of a batch of structures, each structure's in order of ``atom_idx``; ``code`` counts the elements by name."""

    def __init__(self, batch: pa.RecordBatch, columns: list[str]):
        rows = batch.column("rows")
        start = rows.offsets.to_numpy()
        flat = rows.values.slice(start[0], start[-1] - start[0])
        fields = dict(zip([f.name for f in flat.type], flat.flatten()))
        self.ids, self.offsets, self.index = batch.column("structure_id"), start - start[0], fields["atom_idx"]
        self.of = np.repeat(np.arange(len(batch)), np.diff(self.offsets))
        self.points = np.stack([fields[c].to_numpy(zero_copy_only=False).astype(float) for c in columns], axis=1)
        self.cells = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in g.LATTICE], axis=1)
        coded = pc.fill_null(fields["element"], "(null)").dictionary_encode()
        found = coded.dictionary.to_pylist()
        self.names = sorted(found)
        self.code = np.array([self.names.index(x) for x in found], dtype=int)[coded.indices.to_numpy(zero_copy_only=False)]
        self.inverse = np.linalg.inv(self.cells.reshape(-1, 3, 3))
        self.steps = np.linalg.norm(self.inverse, axis=1)  # a step along an axis is no longer than this for each Angstrom

    def known(self, name: str, place: int) -> np.ndarray:
        """A property of each element; one without it raises instead of losing its atoms."""
        for e in self.names:
            if e not in dims.ELEMENTS:
                raise ValueError(f"no {name} is known for element {e}")
        return np.array([dims.ELEMENTS[e][place] for e in self.names])

    def moved(self, d: np.ndarray, shift: np.ndarray, of: np.ndarray) -> np.ndarray:
        """``d`` and whole steps along the axes of structures ``of``."""
        return np.stack([d[:, c] + shift[:, 0] * self.cells[of, c] + shift[:, 1] * self.cells[of, 3 + c] + shift[:, 2] * self.cells[of, 6 + c] for c in range(3)], axis=1)

    def meeting(self, places: np.ndarray, reach: np.ndarray):
        """Blocks of (a, b): for every atom a those with an image within its ``reach``, and some more; an atom may meet itself.

        A cell is cut into boxes of at least BOX, or is one box; an atom meets
        those that lie in the boxes its reach touches, round the cell's edges, so
        the work grows with the atoms and not with their pairs. ``places`` are
        fractional; atoms without a place meet none.
        """
        sizes, steps = np.diff(self.offsets), self.steps
        with np.errstate(invalid="ignore"):
            n = np.nan_to_num(np.clip(np.floor(1 / steps / BOX), 1, np.maximum(sizes, 1)[:, None]), nan=1).astype(np.int64)
        at = np.flatnonzero(np.isfinite(places).all(axis=1) & np.isfinite(steps[self.of]).all(axis=1))
        of, cut = self.of[at], n[self.of[at]]
        base = np.cumsum(n.prod(axis=1)) - n.prod(axis=1)
        inside = places[at] - np.floor(places[at])
        key = lambda of, cut, box: base[of] + (box[:, 0] * cut[:, 1] + box[:, 1]) * cut[:, 2] + box[:, 2]
        own = key(of, cut, np.minimum(np.floor(inside * cut).astype(np.int64), cut - 1))
        order = np.argsort(own, kind="stable")
        own = own[order]
        far = reach[at, None] * steps[of] + 1e-9
        low = np.floor((inside - far) * cut).astype(np.int64)
        width = np.minimum(np.floor((inside + far) * cut).astype(np.int64), low + cut - 1) - low + 1
        for lo, hi in batches.blocks(width.prod(axis=1)):
            row, k = batches.spread(width[lo:hi].prod(axis=1))
            row += lo
            w, c = width[row], cut[row]
            target = key(of[row], c, (low[row] + np.stack([k // (w[:, 1] * w[:, 2]), k // w[:, 2] % w[:, 1], k % w[:, 2]], axis=1)) % c)
            start = np.searchsorted(own, target)
            count = np.searchsorted(own, target, side="right") - start
            for x, y in batches.blocks(count):
                which, k = batches.spread(count[x:y])
                yield at[row[x:y][which]], at[order[start[x:y][which] + k]]

    def contacts(self, scale: float = 1.2, hydrogen: float = 1.3) -> Bonds:
        """The shortest image of each pair that lies within the scaled radius sum."""
        radius = self.known("radius", 1)[self.code]
        light = np.array([e == "H" for e in self.names], dtype=bool)[self.code]
        most = max(scale, hydrogen)
        found = [(np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty((0, 3), dtype=np.int64), np.empty(0))]
        places = np.einsum("ij,ijk->ik", self.points, self.inverse[self.of])
        for a, b in self.meeting(places, 2 * radius * most):  # the larger atom looks for the other, which is no further than this
            looks = (radius[a] > radius[b]) | (radius[a] == radius[b]) & (a < b)
            i, j = np.minimum(a, b)[looks], np.maximum(a, b)[looks]
            of, longest = self.of[i], (radius[i] + radius[j]) * np.where(light[i] | light[j], most, scale)
            d = self.points[j] - self.points[i]
            f, r = np.einsum("ij,ijk->ik", d, self.inverse[of]), longest[:, None] * self.steps[of] + 1e-9
            low = np.ceil(-r - f).astype(np.int64)
            width = np.maximum(np.floor(r - f).astype(np.int64) - low + 1, 0)
            for lo, hi in batches.blocks(width.prod(axis=1)):
                row, k = batches.spread(width[lo:hi].prod(axis=1))
                row += lo
                w = width[row]
                s = low[row] + np.stack([k // (w[:, 1] * w[:, 2]), k // w[:, 2] % w[:, 1], k % w[:, 2]], axis=1)
                x, y, z = self.moved(d[row], s, of[row]).T
                distance = np.sqrt(x * x + y * y + z * z)
                near = np.flatnonzero(distance <= longest[row])
                found.append((i[row[near]], j[row[near]], s[near], distance[near]))
        i, j, s, distance = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((s[:, 2], s[:, 1], s[:, 0], distance, j, i))
        first = np.ones(len(order), dtype=bool)
        first[1:] = (i[order[1:]] != i[order[:-1]]) | (j[order[1:]] != j[order[:-1]])
        order = order[first]
        i, j = i[order], j[order]
        return Bonds(self, i, j, s[order], distance[order], distance[order] / (radius[i] + radius[j]))

    def within_cutoffs(self) -> Bonds:
        """Pairs strictly within the cutoff of their elements, by the nearest image of fractional places."""
        cutoffs = np.zeros((len(self.names), len(self.names)))
        for (e, o), c in dims.PAIR_CUTOFFS.items():
            if e in self.names and o in self.names:
                p, q = self.names.index(e), self.names.index(o)
                cutoffs[p, q] = cutoffs[q, p] = c
        found = [(np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0))]
        for i, j in self.meeting(self.points, np.full(len(self.points), max(dims.PAIR_CUTOFFS.values()))):
            cutoff = cutoffs[self.code[i], self.code[j]]
            some = np.flatnonzero((i < j) & (cutoff > 0))
            i, j, cutoff = i[some], j[some], cutoff[some]
            d = self.points[j] - self.points[i]
            d, c = d - np.rint(d), self.cells[self.of[i]]
            x, y, z = (d[:, 0] * c[:, k] + d[:, 1] * c[:, 3 + k] + d[:, 2] * c[:, 6 + k] for k in range(3))
            distance = np.sqrt(x * x + y * y + z * z)
            near = np.flatnonzero(distance < cutoff)
            found.append((i[near], j[near], distance[near]))
        i, j, distance = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((j, i))
        return Bonds(self, i[order], j[order], np.zeros((len(order), 3), dtype=np.int64), distance[order], distance[order])


class Bonds:
    """Bonds of a batch's atoms, by their places in the flat arrays (i before j), with steps along the axes to the image of j."""

    def __init__(self, atoms: Atoms, i: np.ndarray, j: np.ndarray, s: np.ndarray, distance: np.ndarray, ratio: np.ndarray):
        self.atoms, self.i, self.j, self.s, self.distance, self.ratio = atoms, i, j, s, distance, ratio

    def kept(self, keep: np.ndarray) -> Bonds:
        return Bonds(self.atoms, self.i[keep], self.j[keep], self.s[keep], self.distance[keep], self.ratio[keep])

    def single_hydrogen(self) -> Bonds:
        """Each hydrogen keeps its shortest bond; hydrogens choose in index order, so an earlier choice removes bonds that a later one would see."""
        light = np.array([e == "H" for e in self.atoms.names], dtype=bool)[self.atoms.code]
        ends, bond = np.concatenate([self.i, self.j]), np.tile(np.arange(len(self.i)), 2)
        several = light & (np.bincount(ends, minlength=len(light)) > 1)
        bond, ends = bond[several[ends]], ends[several[ends]]
        order = np.lexsort((self.j[bond], self.i[bond], self.ratio[bond], self.distance[bond], ends))  # the shortest of an atom first
        alive, before, kept = np.ones(len(self.i), dtype=bool), -1, False
        for e, b in zip(ends[order].tolist(), bond[order].tolist()):
            kept = kept and e == before
            if alive[b]:
                alive[b], kept = not kept, True
            before = e
        return self.kept(alive)

    def labels(self) -> np.ndarray:
        """For each atom the first that bonds reach from it."""
        label = np.arange(len(self.atoms.of))
        while True:
            a, b = label[self.i], label[self.j]
            apart = a != b
            if not apart.any():
                return label
            np.minimum.at(label, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
            while (label[label] != label).any():
                label = label[label]

    def unwrapped(self, label: np.ndarray) -> np.ndarray:
        """Places of the atoms with each molecule in one piece, walked from its first atom along bonds in order of their ends."""
        shift = np.zeros((len(label), 3), dtype=np.int64)
        split = np.zeros(len(label), dtype=bool)
        split[label[self.i[self.s.any(axis=1)]]] = True
        here = split[label[self.i]]
        near: dict[int, list] = {}
        for i, j, s in zip(self.i[here].tolist(), self.j[here].tolist(), self.s[here].tolist()):
            near.setdefault(i, []).append((j, s, 1))
            near.setdefault(j, []).append((i, s, -1))
        for start in np.flatnonzero(split).tolist():
            done, stack = {start: (0, 0, 0)}, [start]
            while stack:
                k = stack.pop()
                x, y, z = done[k]
                for m, s, way in near[k]:
                    if m not in done:
                        done[m] = (x + way * s[0], y + way * s[1], z + way * s[2])
                        stack.append(m)
            shift[list(done)] = list(done.values())
        return self.atoms.points + self.atoms.moved(np.zeros((len(label), 3)), shift, self.atoms.of)


def in_batches(atoms: DataFrame, columns: list[str], function, schema: str) -> DataFrame:
    """Rows of ``schema`` that ``function`` makes of ``Atoms`` with the places ``columns``; ``structure_id`` comes first.

    It gives the places of the structures that rows belong to, and the other
    fields in order. Atoms need lattice columns.
    """
    lists = atoms.groupBy("structure_id").agg(*[F.first(c).alias(c) for c in g.LATTICE], F.array_sort(F.collect_list(F.struct("atom_idx", "element", *columns))).alias("rows"))
    schema = f"structure_id {dict(atoms.dtypes)['structure_id']}, {schema}"

    def run(record_batches):
        for whole in record_batches:
            for lo, hi in batches.blocks(np.diff(whole.column("rows").offsets.to_numpy()), STEP):
                found = Atoms(whole.slice(lo, hi - lo), columns)
                of, fields = function(found)
                arrays = [found.ids.take(pa.array(of)), *fields.values()]
                yield pa.RecordBatch.from_arrays(arrays, names=["structure_id", *fields])

    return lists.mapInArrow(run, schema)


def bond_rows(atoms: DataFrame, columns: list[str], find) -> DataFrame:
    """A row for each of the ``Bonds`` that ``find`` makes of ``Atoms``."""

    def rows(found: Atoms):
        b = find(found)
        names = pa.array(found.names, pa.string())
        i, j = pa.array(b.i), pa.array(b.j)
        out = {"i": found.index.take(i), "j": found.index.take(j), "element1": names.take(pa.array(found.code[b.i])), "element2": names.take(pa.array(found.code[b.j]))}
        out |= {f"s{c}": pa.array(b.s[:, k].astype(np.int32)) for k, c in enumerate("xyz")}
        return found.of[b.i], out | {"distance": pa.array(b.distance), "ratio": pa.array(b.ratio)}

    index = dict(atoms.dtypes)["atom_idx"]
    return in_batches(atoms, columns, rows, f"i {index}, j {index}, element1 string, element2 string, sx int, sy int, sz int, distance double, ratio double")


def heavy_neighbours(atoms: DataFrame) -> DataFrame:
    """(structure_id, atom_idx, element, n, parent): for every hydrogen the number of heavy atoms within the pair cutoffs and the first of their elements by name, both null if there are none."""

    def rows(found: Atoms):
        b = found.within_cutoffs()
        light = np.array([e == "H" for e in found.names], dtype=bool)[found.code]
        ends, others = np.concatenate([b.i, b.j]), np.concatenate([b.j, b.i])
        keep = light[ends] & ~light[others]
        ends, others = ends[keep], others[keep]
        n = np.bincount(ends, minlength=len(light))
        parent = np.full(len(light), len(found.names))
        np.minimum.at(parent, ends, found.code[others])
        names = pa.array([*found.names, None], pa.string())
        element = pc.if_else(pc.equal(names.take(pa.array(found.code)), "(null)"), pa.scalar(None, pa.string()), names.take(pa.array(found.code)))
        return found.of, {"atom_idx": found.index, "element": element, "n": pa.array(n, pa.int64(), mask=n == 0), "parent": names.take(pa.array(parent))}

    return in_batches(atoms, ["fx", "fy", "fz"], rows, f"atom_idx {dict(atoms.dtypes)['atom_idx']}, element string, n long, parent string")


#: What ``structures`` gives, with its type.
FIELDS = {
    "atoms": "array<struct<component: int, atom_idx: int, element: string, x: double, y: double, z: double>>",
    "links": "array<struct<i: int, j: int>>",
    "molecules": "array<struct<component: int, n_atoms: long, n_heavy: long, weight: double, formula: string>>",
}


def structures(atoms: DataFrame, *fields: str, unwrapped: bool = False, single_hydrogen: bool = False, scale: float = 1.2) -> DataFrame:
    """(structure_id, fields): one row a structure with its atoms by molecule, its bonds, or its molecules, as of ``FIELDS``.

    A molecule is named by its smallest atom index. Atoms are put in one piece
    across cell edges if ``unwrapped``; with ``single_hydrogen`` each hydrogen
    keeps its shortest bond.
    """

    def rows(found: Atoms):
        b = found.contacts(scale)
        b = b.single_hydrogen() if single_hydrogen else b
        label, index = b.labels(), found.index.cast(pa.int32())
        names, out = pa.array(found.names, pa.string()), {}
        ends = lambda of: pa.array(np.searchsorted(of, np.arange(len(found.ids) + 1)).astype(np.int32))
        lists = lambda of, values: pa.ListArray.from_arrays(ends(of), pa.StructArray.from_arrays(list(values.values()), names=list(values)))
        if "atoms" in fields:
            order = np.argsort(label, kind="stable")  # labels grow with the structures
            points = (b.unwrapped(label) if unwrapped else found.points)[order]
            members = {"component": index.take(pa.array(label[order])), "atom_idx": index.take(pa.array(order)), "element": names.take(pa.array(found.code[order]))}
            out["atoms"] = lists(found.of, members | {c: pa.array(points[:, k]) for k, c in enumerate("xyz")})
        if "links" in fields:
            out["links"] = lists(found.of[b.i], {"i": index.take(pa.array(b.i)), "j": index.take(pa.array(b.j))})
        if "molecules" in fields:
            mass = found.known("mass", 2)
            key, n = np.unique(label * len(names) + found.code, return_counts=True)
            of, code = key // max(len(names), 1), key % max(len(names), 1)
            first = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.empty(0, dtype=int)
            total = lambda x: np.add.reduceat(x, first) if len(first) else x
            heavy = n * np.array([e != "H" for e in found.names], dtype=bool)[code]
            parts = [found.names[c] + str(k) for c, k in zip(code.tolist(), n.tolist())]
            bounds = [*first.tolist(), len(parts)]
            formula = [parts[x] if y == x + 1 else "".join(parts[x:y]) for x, y in zip(bounds, bounds[1:])]
            head = of[first]
            out["molecules"] = lists(found.of[head], {"component": index.take(pa.array(head)), "n_atoms": pa.array(total(n), pa.int64()), "n_heavy": pa.array(total(heavy), pa.int64()), "weight": pa.array(total(n * mass[code])), "formula": pa.array(formula, pa.string())})
        return np.arange(len(found.ids)), out

    order = [f for f in FIELDS if f in fields]
    return in_batches(atoms, ["x", "y", "z"], rows, ", ".join(f"{f} {FIELDS[f]}" for f in order))
