"""Sites and operations of many cells at once: the atoms of a batch in flat arrays, structure after structure.

Structures differ in size, so work is laid out as rows of (atom, structure) and
repeated by counts; no step loops over structures. Blocks bound the memory.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from crystalspark.operators import lattices

#: Pairs of atoms, and rows of moved atoms, that a block holds at most.
BLOCK = 2_000_000


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``counts`` its index, as often as it says, and the running number within it."""
    which = np.repeat(np.arange(len(counts)), counts)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)


def blocks(counts: np.ndarray, most: int = BLOCK):
    """(from, to) of consecutive counts that sum up to about ``most``."""
    ends, lo = np.cumsum(counts), 0
    while lo < len(counts):
        before = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield lo, hi
        lo = hi


class Runs:
    """A batch's atoms sorted by structure and element, each element of a structure one run; order within a run is the given one."""

    def __init__(self, points: np.ndarray, elements: np.ndarray, offsets: np.ndarray, cells: np.ndarray):
        names, code = np.unique(elements, return_inverse=True)
        self.sizes = np.diff(offsets)
        of = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.order = np.lexsort((code, of))
        self.of, code = of[self.order], code[self.order]
        self.points, self.cells, self.offsets = points[self.order], cells, offsets
        new = np.ones(len(code), dtype=bool)
        new[1:] = (self.of[1:] != self.of[:-1]) | (code[1:] != code[:-1])
        self.start = np.flatnonzero(new)
        self.length = np.diff(np.append(self.start, len(code)))
        self.run = np.cumsum(new) - 1
        self.first_run = np.searchsorted(self.of[self.start], np.arange(len(self.sizes)))
        self.axes = np.linalg.norm(np.linalg.inv(cells), axis=1)  # a step along an axis is no longer than this for each Angstrom

    def near(self, x: np.ndarray, run: np.ndarray, tolerance: float):
        """(row of x, atom, distance) of nearest images within ``tolerance``, the atoms of one run each, in order, in blocks."""
        size = self.length[run]
        for lo, hi in blocks(size):
            row, place = spread(size[lo:hi])
            at = np.repeat(self.start[run[lo:hi]], size[lo:hi]) + place
            of = self.of[self.start[run[lo:hi]]]
            d = x[lo:hi, 0][row] - self.points[at, 0]
            keep = np.flatnonzero(np.abs(d - np.rint(d)) <= (tolerance * self.axes[of, 0] + 1e-9)[row])
            row, at = row[keep], at[keep]
            d = x[lo:hi][row] - self.points[at]
            d = np.einsum("ij,ijk->ik", d - np.rint(d), self.cells[of[row]])
            far = np.linalg.norm(d, axis=1)
            keep = far <= tolerance
            yield row[keep] + lo, at[keep], far[keep]

    def landing(self, x: np.ndarray, run: np.ndarray, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
        """The atom of its run nearest to each row of ``x`` within ``tolerance``, or -1, and how far it is; atoms nearer to each other than that stay apart."""
        out, distance = np.full(len(x), -1), np.full(len(x), np.inf)
        for row, at, far in self.near(x, run, tolerance):
            new = np.ones(len(row), dtype=bool)
            new[1:] = row[1:] != row[:-1]
            if not new.all():
                order = np.lexsort((far, row))  # stable: the first of equally near ones
                row, at, far = row[order], at[order], far[order]
            out[row[new]], distance[row[new]] = at[new], far[new]
        return out, distance


def greedy(points: np.ndarray, elements: np.ndarray, offsets: np.ndarray, cells: np.ndarray, tolerance: float) -> np.ndarray:
    """Which sites stay when each in order is dropped that lies within ``tolerance`` of an earlier kept one of its element and structure."""
    runs, found = Runs(points, elements, offsets, cells), [(np.empty(0, dtype=int),) * 2]
    for row, at, _ in runs.near(runs.points, runs.run, tolerance):
        earlier = at < row
        found.append((row[earlier], at[earlier]))
    row, at = (np.concatenate(x) for x in zip(*found))
    keep, open_ = np.ones(len(points), dtype=bool), np.zeros(len(points), dtype=bool)
    open_[row] = True
    while len(row):  # a site is settled once all its earlier neighbours are, or one of them stays
        beside = keep[at] & ~open_[at]
        dropped = np.zeros(len(points), dtype=bool)
        dropped[row[beside]] = True
        waits = np.zeros(len(points), dtype=bool)
        waits[row[open_[at]]] = True
        keep[dropped] = False
        open_ &= waits & ~dropped
        left = open_[row] & ~(~keep[at] & ~open_[at])
        row, at = row[left], at[left]
    out = np.empty(len(points), dtype=bool)
    out[runs.order] = keep
    return out


@lru_cache(4096)
def _lattice(cell: bytes, symprec: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(change to the reduced basis, reduced cell, its rotations) of a cell; cells of one lattice may follow one another."""
    p, small = lattices.reduced(np.frombuffer(cell).reshape(3, 3))
    return p, small, lattices.rotations(small, symprec)


class Symmetry:
    """Operations of each structure of a batch, in its reduced basis, and the orbits of its atoms.

    ``of``, ``rotation`` and ``shift`` have a row an operation, in order of
    structures; ``label`` has, per atom, the smallest index (within its
    structure) of the atoms that operations map onto each other.
    """

    def __init__(self, points: np.ndarray, elements: np.ndarray, offsets: np.ndarray, cells: np.ndarray, symprec: float = 0.05):
        kinds, kind = np.unique(cells.reshape(-1, 9), axis=0, return_inverse=True)
        each = [_lattice(np.ascontiguousarray(c).tobytes(), symprec) for c in kinds]
        kind = kind.ravel()
        self.p, self.back = (np.array([f(x[0]) for x in each]).reshape(-1, 3, 3)[kind] for f in (lambda p: p, lattices.inverse))
        small = np.array([x[1] for x in each]).reshape(-1, 3, 3)[kind]
        all_rotations = np.concatenate([x[2] for x in each]) if each else np.empty((0, 3, 3), dtype=int)
        many = np.array([len(x[2]) for x in each], dtype=int)
        first_rotation = (np.cumsum(many) - many)[kind]
        sizes, self.offsets = np.diff(offsets), offsets
        of = np.repeat(np.arange(len(sizes)), sizes)
        runs = Runs(np.einsum("ij,ijk->ik", points, self.back[of]), elements, offsets, small)
        self.runs = runs
        rarest = np.minimum.reduceat(runs.length * (len(runs.length) + 1) + np.arange(len(runs.length)), runs.first_run) % (len(runs.length) + 1)
        rare = runs.start[rarest]
        n_runs = np.diff(np.append(runs.first_run, len(runs.start)))
        found = [(np.empty(0, dtype=int), np.empty((0, 3, 3), dtype=int), np.empty((0, 3)))]
        sources, targets = [], []
        work = many[kind] * runs.length[rarest] * np.maximum(runs.length[rarest], 8)
        for lo, hi in blocks(work):  # a row for each structure, rotation and atom of the rarest element
            s, k = spread(many[kind[lo:hi]])
            s += lo
            r = all_rotations[first_rotation[s] + k]
            row, j = spread(runs.length[rarest[s]])
            s, r = s[row], r[row]
            shift = runs.points[rare[s] + j] - np.einsum("ij,ijk->ik", runs.points[rare[s]], r)
            last = rare + runs.length[rarest] - 1
            for probe in range(-1, int(n_runs[lo:hi].max(initial=0))):  # most shifts already fail on a few atoms
                here = probe < n_runs[s]
                a = last[s] if probe < 0 else runs.start[np.minimum(runs.first_run[s] + probe, len(runs.start) - 1)]
                tried = np.flatnonzero(here & (a != rare[s]))
                on, _ = runs.landing(np.einsum("ij,ijk->ik", runs.points[a[tried]], r[tried]) + shift[tried], runs.run[a[tried]], symprec)
                good = np.ones(len(s), dtype=bool)
                good[tried[on < 0]] = False
                s, r, shift = s[good], r[good], shift[good]
            shift -= np.floor(shift + 1e-6)
            lands, atoms, ons, misfit = [], [], [], []
            for x, y in blocks(sizes[s]):  # and all atoms of what is left
                row, i = spread(sizes[s[x:y]])
                atom = offsets[s[x:y]][row] + i
                on, far = runs.landing(np.einsum("ij,ijk->ik", runs.points[atom], r[x:y][row]) + shift[x:y][row], runs.run[atom], symprec)
                heads = np.cumsum(sizes[s[x:y]]) - sizes[s[x:y]]
                fits = np.minimum.reduceat(on, heads) >= 0
                misfit.append(np.maximum.reduceat(far, heads))
                lands.append(fits)
                atoms.append(atom[fits[row]])
                ons.append(on[fits[row]])
            good = np.concatenate(lands) if lands else np.empty(0, dtype=bool)
            fits = np.flatnonzero(good)
            good[_repeated(s, r, shift, fits, small, symprec, np.concatenate([np.empty(0), *misfit]))] = False
            found.append((s[good], r[good], shift[good]))
            left = np.repeat(good[fits], sizes[s[fits]])
            sources.append(np.concatenate([np.empty(0, dtype=int), *atoms])[left])
            targets.append(np.concatenate([np.empty(0, dtype=int), *ons])[left])
        self.of, self.rotation, self.shift = (np.concatenate(x) for x in zip(*found))
        self.count = np.bincount(self.of, minlength=len(sizes))
        label = np.arange(len(points))
        a, b = (np.concatenate(x) if x else np.empty(0, dtype=int) for x in (sources, targets))
        a, b = a[a != b], b[a != b]
        while (label[a] != label[b]).any():
            low = np.minimum(label[a], label[b])
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
        self.label = np.empty(len(points), dtype=int)
        self.label[runs.order] = runs.order[label] - offsets[of[runs.order]]

    def given(self) -> tuple[np.ndarray, np.ndarray]:
        """Rotations and translations in the bases in which the cells were given."""
        p, back = self.p[self.of], self.back[self.of]
        shift = np.einsum("ij,ijk->ik", self.shift, p)
        return back @ self.rotation @ p, shift - np.floor(shift + 1e-6)


def _repeated(s, r, shift, at, cells, symprec, misfit) -> list[int]:
    """Of the candidates ``at`` of the same structure and rotation those to drop: each within ``symprec`` of an earlier one is taken as the same, and of these the best fit stays."""
    same = (s[at[1:]] == s[at[:-1]]) & (r[at[1:]] == r[at[:-1]]).all(axis=(1, 2))
    bounds = np.flatnonzero(np.concatenate([[True], ~same, [True]])) if len(at) else np.zeros(1, dtype=int)
    group, before = spread(np.diff(bounds))  # how many of its group come before each candidate
    close = np.zeros(len(bounds) - 1, dtype=bool)
    for lo, hi in blocks(before):
        row, k = spread(before[lo:hi])
        x, y = at[lo + row], at[lo + row - 1 - k]
        d = shift[x] - shift[y]
        d = np.einsum("ij,ijk->ik", d - np.rint(d), cells[s[x]])
        close[group[lo + row[np.linalg.norm(d, axis=1) <= symprec * (1 + 1e-9)]]] = True
    several = np.flatnonzero(close)  # only in these one may lie on another
    out: list[int] = []
    for x, y in zip(bounds[several], bounds[several + 1]):
        kept, best = [at[x]], [at[x]]
        for c in at[x + 1 : y]:
            d = shift[c] - shift[kept]
            same = np.flatnonzero(np.linalg.norm((d - np.rint(d)) @ cells[s[c]], axis=1) <= symprec)
            if not len(same):
                kept.append(c)
                best.append(c)
            elif misfit[c] < misfit[best[same[0]]] - 1e-6:
                out.append(int(best[same[0]]))
                best[same[0]] = c
            else:
                out.append(int(c))
    return out
