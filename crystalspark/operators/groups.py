"""Names of space groups: operation sets matched against tabled groups up to basis and origin.

An operation is (rotation, translation) on fractional columns, ``x' = r x + t``.
A set in any basis is first brought to a primitive basis; its axes, read off
the rotations, give the few candidates of a conventional basis. In each, the
rotations have to be those of a tabled group, and the origin shift that makes
the translations agree is solved for modulo the lattice. A set without a match
has no name, never a guess.
"""

from __future__ import annotations

from fractions import Fraction
from functools import lru_cache
from itertools import permutations, product

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crystalspark.operators import lattices, symmetry

#: Number, symbol, Hall symbol of the standard setting, its place in the list of 530 settings, origins listed (fixed values).
GROUPS = """
1|P 1|P 1|1|1
2|P -1|-P 1|2|1
3|P 2|P 2y|3|1
4|P 21|P 2yb|6|1
5|C 2|C 2y|9|1
6|P m|P -2y|18|1
7|P c|P -2yc|21|1
8|C m|C -2y|30|1
9|C c|C -2yc|39|1
10|P 2/m|-P 2y|57|1
11|P 21/m|-P 2yb|60|1
12|C 2/m|-C 2y|63|1
13|P 2/c|-P 2yc|72|1
14|P 21/c|-P 2ybc|81|1
15|C 2/c|-C 2yc|90|1
16|P 2 2 2|P 2 2|108|1
17|P 2 2 21|P 2c 2|109|1
18|P 21 21 2|P 2 2ab|112|1
19|P 21 21 21|P 2ac 2ab|115|1
20|C 2 2 21|C 2c 2|116|1
21|C 2 2 2|C 2 2|119|1
22|F 2 2 2|F 2 2|122|1
23|I 2 2 2|I 2 2|123|1
24|I 21 21 21|I 2b 2c|124|1
25|P m m 2|P 2 -2|125|1
26|P m c 21|P 2c -2|128|1
27|P c c 2|P 2 -2c|134|1
28|P m a 2|P 2 -2a|137|1
29|P c a 21|P 2c -2ac|143|1
30|P n c 2|P 2 -2bc|149|1
31|P m n 21|P 2ac -2|155|1
32|P b a 2|P 2 -2ab|161|1
33|P n a 21|P 2c -2n|164|1
34|P n n 2|P 2 -2n|170|1
35|C m m 2|C 2 -2|173|1
36|C m c 21|C 2c -2|176|1
37|C c c 2|C 2 -2c|182|1
38|A m m 2|A 2 -2|185|1
39|A e m 2|A 2 -2b|191|1
40|A m a 2|A 2 -2a|197|1
41|A e a 2|A 2 -2ab|203|1
42|F m m 2|F 2 -2|209|1
43|F d d 2|F 2 -2d|212|1
44|I m m 2|I 2 -2|215|1
45|I b a 2|I 2 -2c|218|1
46|I m a 2|I 2 -2a|221|1
47|P m m m|-P 2 2|227|1
48|P n n n|-P 2ab 2bc|229|2
49|P c c m|-P 2 2c|230|1
50|P b a n|-P 2ab 2b|234|2
51|P m m a|-P 2a 2a|239|1
52|P n n a|-P 2a 2bc|245|1
53|P m n a|-P 2ac 2|251|1
54|P c c a|-P 2a 2ac|257|1
55|P b a m|-P 2 2ab|263|1
56|P c c n|-P 2ab 2ac|266|1
57|P b c m|-P 2c 2b|269|1
58|P n n m|-P 2 2n|275|1
59|P m m n|-P 2ab 2a|279|2
60|P b c n|-P 2n 2ab|284|1
61|P b c a|-P 2ac 2ab|290|1
62|P n m a|-P 2ac 2n|292|1
63|C m c m|-C 2c 2|298|1
64|C m c e|-C 2bc 2|304|1
65|C m m m|-C 2 2|310|1
66|C c c m|-C 2 2c|313|1
67|C m m e|-C 2b 2|316|1
68|C c c e|-C 2b 2bc|323|2
69|F m m m|-F 2 2|334|1
70|F d d d|-F 2uv 2vw|336|2
71|I m m m|-I 2 2|337|1
72|I b a m|-I 2 2c|338|1
73|I b c a|-I 2b 2c|341|1
74|I m m a|-I 2b 2|343|1
75|P 4|P 4|349|1
76|P 41|P 4w|350|1
77|P 42|P 4c|351|1
78|P 43|P 4cw|352|1
79|I 4|I 4|353|1
80|I 41|I 4bw|354|1
81|P -4|P -4|355|1
82|I -4|I -4|356|1
83|P 4/m|-P 4|357|1
84|P 42/m|-P 4c|358|1
85|P 4/n|-P 4a|360|2
86|P 42/n|-P 4bc|362|2
87|I 4/m|-I 4|363|1
88|I 41/a|-I 4ad|365|2
89|P 4 2 2|P 4 2|366|1
92|P 41 21 2|P 4abw 2nw|369|1
96|P 43 21 2|P 4nw 2abw|373|1
113|P -4 21 m|P -4 2ab|390|1
114|P -4 21 c|P -4 2n|391|1
122|I -4 2 d|I -4 2bw|399|1
123|P 4/m m m|-P 4 2|400|1
129|P 4/n m m|-P 4a 2a|409|2
136|P 42/m n m|-P 4n 2n|419|1
139|I 4/m m m|-I 4 2|424|1
140|I 4/m c m|-I 4 2c|425|1
141|I 41/a m d|-I 4bd 2|427|2
142|I 41/a c d|-I 4bd 2c|429|2
143|P 3|P 3|430|1
144|P 31|P 31|431|1
145|P 32|P 32|432|1
146|R 3|R 3|433|1
147|P -3|-P 3|435|1
148|R -3|-R 3|436|1
149|P 3 1 2|P 3 2|438|1
150|P 3 2 1|P 3 2"|439|1
152|P 31 2 1|P 31 2"|441|1
154|P 32 2 1|P 32 2"|443|1
155|R 3 2|R 3 2"|444|1
159|P 3 1 c|P 3 -2c|449|1
160|R 3 m|R 3 -2"|450|1
161|R 3 c|R 3 -2"c|452|1
166|R -3 m|-R 3 2"|458|1
167|R -3 c|-R 3 2"c|460|1
168|P 6|P 6|462|1
169|P 61|P 61|463|1
170|P 65|P 65|464|1
173|P 63|P 6c|467|1
175|P 6/m|-P 6|469|1
176|P 63/m|-P 6c|470|1
182|P 63 2 2|P 6c 2c|476|1
186|P 63 m c|P 6c -2c|480|1
191|P 6/m m m|-P 6 2|485|1
194|P 63/m m c|-P 6c 2c|488|1
195|P 2 3|P 2 2 3|489|1
196|F 2 3|F 2 2 3|490|1
197|I 2 3|I 2 2 3|491|1
198|P 21 3|P 2ac 2ab 3|492|1
199|I 21 3|I 2b 2c 3|493|1
200|P m -3|-P 2 2 3|494|1
202|F m -3|-F 2 2 3|497|1
204|I m -3|-I 2 2 3|500|1
205|P a -3|-P 2ac 2ab 3|501|1
206|I a -3|-I 2b 2c 3|502|1
207|P 4 3 2|P 4 2 3|503|1
215|P -4 3 m|P -4 2 3|511|1
216|F -4 3 m|F -4 2 3|512|1
217|I -4 3 m|I -4 2 3|513|1
218|P -4 3 n|P -4n 2 3|514|1
220|I -4 3 d|I -4bd 2c 3|516|1
221|P m -3 m|-P 4 2 3|517|1
224|P n -3 m|-P 4bc 2bc 3|522|2
225|F m -3 m|-F 4 2 3|523|1
227|F d -3 m|-F 4vw 2vw 3|526|2
229|I m -3 m|-I 4 2 3|529|1
230|I a -3 d|-I 4bd 2c 3|530|1
"""

#: Groups whose listed settings may differ in nothing but the origin, and of these such where every exchange is listed (fixed values).
BY_ORIGIN, EVERY_EXCHANGE = {9, 15, 67, 68, 73}, {67, 68}
Set = dict[tuple, tuple]  # rotation (rows) to translation, in a primitive basis

#: Centring translations, in 24ths, and the translations that letters of a Hall symbol stand for (fixed values).
CENTRINGS = {
    "P": [(0, 0, 0)], "A": [(0, 0, 0), (0, 12, 12)], "B": [(0, 0, 0), (12, 0, 12)], "C": [(0, 0, 0), (12, 12, 0)], "I": [(0, 0, 0), (12, 12, 12)],
    "R": [(0, 0, 0), (16, 8, 8), (8, 16, 16)], "F": [(0, 0, 0), (0, 12, 12), (12, 0, 12), (12, 12, 0)],
}
STEPS = {"a": (12, 0, 0), "b": (0, 12, 0), "c": (0, 0, 12), "n": (12, 12, 12), "u": (6, 0, 0), "v": (0, 6, 0), "w": (0, 0, 6), "d": (6, 6, 6)}
#: Rotations about z by order, about the diagonals a-b (') and a+b ("), and about a+b+c (*) (fixed values).
ABOUT_Z = {1: ((1, 0, 0), (0, 1, 0), (0, 0, 1)), 2: ((-1, 0, 0), (0, -1, 0), (0, 0, 1)), 3: ((0, -1, 0), (1, -1, 0), (0, 0, 1)), 4: ((0, -1, 0), (1, 0, 0), (0, 0, 1)), 6: ((1, -1, 0), (1, 0, 0), (0, 0, 1))}
DIAGONAL = {"'": ((0, -1, 0), (-1, 0, 0), (0, 0, -1)), '"': ((0, 1, 0), (1, 0, 0), (0, 0, -1)), "*": ((0, 0, 1), (1, 0, 0), (0, 1, 0))}


def hall(symbol: str) -> tuple[str, list[tuple[np.ndarray, np.ndarray]]]:
    """(centring letter, all operations without centring; translations in 24ths) that a Hall symbol generates."""
    first, *words = symbol.split()
    letter, generators, before = first.lstrip("-"), [], 0
    if first.startswith("-"):
        generators.append((-np.eye(3, dtype=int), np.zeros(3, dtype=int)))
    for place, word in enumerate(words):
        sign, word = (-1, word[1:]) if word.startswith("-") else (1, word)
        order, rest = int(word[0]), word[1:]
        axis = next((c for c in rest if c in "xyz'\"*"), None) or ("z" if place == 0 else "*" if order == 3 else "x" if before in (2, 4) else "'")
        turn = {"z": 0, "x": 1, "y": 2}.get(axis)
        if order == 1 or turn is None:
            r = np.array(ABOUT_Z[1] if order == 1 else DIAGONAL[axis])
        else:  # x and y by cyclic exchange of the axes
            r = np.roll(np.roll(np.array(ABOUT_Z[order]), turn, axis=0), turn, axis=1)
        t = np.zeros(3, dtype=int)
        for c in rest:
            if c in STEPS:
                t += STEPS[c]
            elif c.isdigit():  # screw along the axis
                t["zxy".index(axis) - 1 if axis != "z" else 2] += 24 * int(c) // order
        generators.append((sign * r, t))
        before = before or order
    return letter, closed(generators)


def closed(generators: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """One operation for each rotation of the group that the generators make (translations in 24ths, modulo the lattice)."""
    found = {ABOUT_Z[1]: (np.eye(3, dtype=int), np.zeros(3, dtype=int))}
    new = list(found.values())
    while new:
        made = []
        for (r, t), (g, s) in product(new, generators):
            x = g @ r, (g @ t + s) % 24
            if _key(x[0]) not in found:
                found[_key(x[0])] = x
                made.append(x)
        new = made
    return list(found.values())


def _key(r) -> tuple:
    return tuple(tuple(int(x) for x in row) for row in r)


def rows_of() -> list[tuple[int, str, str, int, int]]:
    """The table, read."""
    lines = [x.split("|") for x in GROUPS.strip().splitlines()]
    return [(int(n), symbol, name, int(place), int(step)) for n, symbol, name, place, step in lines]


@lru_cache(1)
def standard() -> dict[tuple, list[tuple[int, str, Set]]]:
    """By (centring translations, rotations) of the standard setting: (number, symbol, operations in the primitive basis of the centring)."""
    out: dict[tuple, list] = {}
    for number, symbol, name, *_ in rows_of():
        letter, operations = hall(name)
        q = lattices.primitive(np.array(CENTRINGS[letter]) / 24, 24) / 24
        out.setdefault((frozenset(CENTRINGS[letter]), frozenset(_key(r) for r, _ in operations)), []).append((number, symbol, in_basis([(r, t / 24) for r, t in operations], q)))
    return out


def in_basis(operations: list[tuple[np.ndarray, np.ndarray]], basis: np.ndarray) -> Set:
    """One operation for each rotation, in the basis whose vectors are the rows of ``basis``."""
    to = np.linalg.inv(basis.T)
    return {_key(np.rint(to @ r @ basis.T).astype(int)): tuple(to @ t) for r, t in operations}


def axis(r: np.ndarray) -> np.ndarray:
    """The shortest lattice vector along the axis of a proper rotation."""
    order = next(n for n in (1, 2, 3, 4, 6) if (np.linalg.matrix_power(r, n) == np.eye(3)).all())
    total = sum(np.linalg.matrix_power(r, k) for k in range(order))
    v = total[:, np.flatnonzero(total.any(axis=0))[0]]
    return v // np.gcd.reduce(v)


def plane(normal_map: np.ndarray) -> np.ndarray:
    """Two lattice vectors that span what an integer matrix sends to zero (a plane)."""
    row = normal_map[np.flatnonzero(normal_map.any(axis=1))[0]]
    row = row // np.gcd.reduce(row)
    rows, basis = [[int(x) for x in r] for r in np.column_stack([row, np.eye(3, dtype=int)])], []
    while sum(r[0] != 0 for r in rows) > 1:  # the same row operations take the row to its divisor and the unit vectors to the plane
        pivot = min((r for r in rows if r[0]), key=lambda r: abs(r[0]))
        rows = [r if r is pivot else [x - (r[0] // pivot[0]) * y for x, y in zip(r, pivot)] for r in rows]
    basis = [r[1:] for r in rows if not r[0]]
    return np.array(basis)


def conventional(rotations: list[np.ndarray]):
    """Candidates of a conventional basis (rows, in the primitive basis that the rotations are in), right-handed."""
    proper = {_key(r if np.linalg.det(r) > 0 else -r) for r in rotations}
    turns = [np.array(r) for r in proper if r != ABOUT_Z[1]]
    order = {_key(r): next(n for n in (2, 3, 4, 6) if (np.linalg.matrix_power(r, n) == np.eye(3)).all()) for r in turns}
    metric = sum(r.T @ r for r in map(np.array, proper))  # unchanged by every rotation
    most = max(order.values(), default=1)

    def right_handed(rows):
        rows = np.array(rows)
        return rows if np.linalg.det(rows) > 0 else None

    if not turns:
        yield np.eye(3, dtype=int)
        return
    if len(turns) == 1:
        b, (u, v) = axis(turns[0]), plane_basis(turns[0])
        for m in ((1, 0, 0, 1), (0, 1, 1, 0), (1, 1, 0, 1), (1, 0, 1, 1), (0, 1, 1, 1), (1, 1, 1, 0)):  # all choices modulo 2
            a, c = m[0] * u + m[1] * v, m[2] * u + m[3] * v
            for sign in (1, -1):
                rows = right_handed([a, sign * b, c])
                if rows is not None:
                    yield rows
        return
    cubic = len(turns) in (11, 23) and most < 6
    if cubic or most == 2:
        wanted = 4 if len(turns) == 23 else 2
        axes = {tuple(axis(r)) for r in turns if order[_key(r)] == wanted}
        axes = [np.array(x) for x in {min(x, tuple(-y for y in x)) for x in axes}]
        for triple in permutations(axes, 3):
            for signs in product((1, -1), repeat=3):
                rows = right_handed([s * x for s, x in zip(signs, triple)])
                if rows is not None:
                    yield rows
        return
    main = next(r for r in turns if order[_key(r)] == most)
    third = main if most in (3, 4) else main @ main  # by 120 degrees for hexagonal axes
    u, v = plane_basis(main)
    flat = np.array([i * u + j * v for i in range(-3, 4) for j in range(-3, 4) if i or j])
    length = np.einsum("ij,jk,ik->i", flat, metric, flat)
    for a in flat[length == length.min()]:
        for r in (third, np.linalg.matrix_power(third, 2 if most in (3, 6) else 3)):
            for c in (axis(main), -axis(main)):
                rows = right_handed([a, r @ a, c])
                if rows is not None:
                    yield rows


def plane_basis(r: np.ndarray) -> np.ndarray:
    """Two shortish lattice vectors that span the plane across the axis of a proper rotation."""
    order = next(n for n in (2, 3, 4, 6) if (np.linalg.matrix_power(r, n) == np.eye(3)).all())
    u, v = plane(sum(np.linalg.matrix_power(r, k) for k in range(order)))
    metric = sum((m := np.linalg.matrix_power(r, k)).T @ m for k in range(order))
    while True:  # Gauss reduction
        if v @ metric @ v < u @ metric @ u:
            u, v = v, u
        n = round(float(u @ metric @ v) / float(u @ metric @ u))
        if not n:
            return np.array([u, v])
        v = v - n * u


def identify(operations: list[tuple[np.ndarray, np.ndarray]], tolerance: float = 0.01) -> tuple[int, str] | None:
    """(number, symbol) of a full set of operations (rotation and translation on fractional columns) in any basis and origin."""
    rotations = np.array([r for r, _ in operations]).reshape(-1, 3, 3)
    return identify_like(rotations, np.array([t for _, t in operations], dtype=float).reshape(-1, 3), tolerance)


def identify_like(rotations: np.ndarray, translations: np.ndarray, tolerance: float = 0.01) -> tuple[int, str] | None:
    """``identify`` of operations in arrays; what follows from rotations and centring alone is worked out once for all sets that share them."""
    rotations = np.ascontiguousarray(rotations, dtype=np.int64)
    pure = (rotations == np.eye(3, dtype=int)).all(axis=(1, 2))
    shifts = translations[pure] if pure.any() else np.zeros((1, 3))
    firsts, ways = _ways(rotations.tobytes(), np.rint(len(shifts) * shifts).astype(np.int64).tobytes())
    t = translations[firsts].ravel()
    for number, symbol, wanted, change in ways:
        x = wanted - change @ t
        if (np.abs(x - np.rint(x)) <= tolerance * 4).all():
            return number, symbol
    return None


@lru_cache(4096)
def _ways(rotation_bytes: bytes, shift_bytes: bytes) -> tuple[list[int], list[tuple[int, str, np.ndarray, np.ndarray]]]:
    """Operations whose translations count, one a rotation, and the tabled groups that fit the rotations: (number, symbol, w, c).

    The group is met if ``w - c @ t`` are whole numbers, t those translations.
    """
    each = np.frombuffer(rotation_bytes, dtype=np.int64).reshape(-1, 3, 3)
    steps = np.frombuffer(shift_bytes, dtype=np.int64).reshape(-1, 3)
    first = {_key(r): i for i, r in reversed(list(enumerate(each)))}  # the first operation of each rotation
    pure = sum(_key(r) == ABOUT_Z[1] for r in each)
    matrices = [each[i] for i in first.values()]
    closed_set = all(_key(a @ b) in first for a in matrices for b in matrices)
    if not matrices or len(matrices) > 48 or not closed_set or len(each) != len(first) * max(1, pure):
        return [], []  # not a group: products are missing, or cosets differ in size
    parts = len(steps)
    q = lattices.primitive(steps / parts, parts) / parts
    turned = np.linalg.inv(q.T) @ np.array(matrices) @ q.T
    if abs(abs(np.linalg.det(q)) * parts - 1) > 1e-6 or np.abs(turned - np.rint(turned)).max() > 1e-6:
        return [], []  # nor is this one: near operations, whose centring is not closed or which a rotation takes elsewhere
    width, firsts = 3 * len(first), list(first.values())

    def moved_to(operations: dict[tuple, np.ndarray], basis: np.ndarray) -> dict[tuple, np.ndarray]:
        """``in_basis`` of translations that are rows of linear forms."""
        to = np.linalg.inv(basis.T)
        return {_key(np.rint(to @ np.array(r) @ basis.T).astype(int)): to @ t for r, t in operations.items()}

    forms = {r: np.eye(width)[3 * k : 3 * k + 3] for k, r in enumerate(first)}
    mine, out = moved_to(forms, q), []
    for basis in conventional([np.array(r) for r in mine]):
        size = round(np.linalg.det(basis))
        inside = {tuple(round(24 * x) % 24 for x in np.array(v) @ np.linalg.inv(basis)) for v in product(range(size), repeat=3)} if size > 1 else {(0, 0, 0)}
        moved = moved_to(mine, basis)
        for number, symbol, wanted in standard().get((frozenset(inside), frozenset(moved)), []):
            have = moved_to(moved, lattices.primitive(np.array(sorted(inside)) / 24, 24) / 24)
            rows = np.vstack([np.array(r) - np.eye(3, dtype=int) for r in wanted])
            left = lattices.unsolved(rows)
            out.append((number, symbol, left @ np.concatenate([np.array(wanted[r]) for r in wanted]), left @ np.concatenate([have[r] for r in wanted])))
    return firsts, out


#: Exchanges of axes, as rows in terms of the old ones, in the order in which settings are listed (fixed values).
MONOCLINIC = [np.array(c) for c in (((1, 0, 0), (0, 1, 0), (0, 0, 1)), ((-1, 0, -1), (0, 1, 0), (1, 0, 0)), ((0, 0, 1), (0, 1, 0), (-1, 0, -1)))]
SIGNED = [np.eye(3, dtype=int), np.array(((0, 0, 1), (0, -1, 0), (1, 0, 0)))]
CYCLES = [np.eye(3, dtype=int), np.array(((0, 0, 1), (1, 0, 0), (0, 1, 0))), np.array(((0, 1, 0), (0, 0, 1), (1, 0, 0)))]
ORTHORHOMBIC = [np.array(c) for c in (((1, 0, 0), (0, 1, 0), (0, 0, 1)), ((0, 1, 0), (1, 0, 0), (0, 0, -1)), ((0, 0, 1), (1, 0, 0), (0, 1, 0)), ((0, 0, -1), (0, 1, 0), (1, 0, 0)), ((0, 1, 0), (0, 0, 1), (1, 0, 0)), ((1, 0, 0), (0, 0, -1), (0, 1, 0)))]


def same_origin(wanted: Set, have: Set, tolerance: float) -> bool:
    """Whether a shift of the origin, which changes t to t + (r - 1) x, takes one set to the other; both in a primitive basis."""
    rows = np.vstack([np.array(r) - np.eye(3, dtype=int) for r in wanted])
    gap = np.concatenate([np.array(wanted[r]) - np.array(have[r]) for r in wanted])
    return lattices.integer_solution(rows, gap, tolerance) is not None


def same_set(wanted: Set, have: Set) -> bool:
    """Whether translations agree modulo the lattice, both sets in one primitive basis."""
    gaps = [x - y for r in wanted for x, y in zip(wanted[r], have[r])]
    return all(abs(x - round(x)) < 0.01 for x in gaps)


def located(full: list[tuple[np.ndarray, np.ndarray]]) -> tuple[tuple, Set]:
    """((centring translations, rotations), one operation a rotation in the primitive basis) of full operations in 24ths."""
    inside = frozenset(tuple(int(x) % 24 for x in t) for r, t in full if _key(r) == ABOUT_Z[1])
    p = lattices.primitive(np.array(sorted(inside)) / 24, 24) / 24
    return (inside, frozenset(_key(r) for r, _ in full)), in_basis([(r, np.array(t) / 24) for r, t in full], p)


@lru_cache(1)
def settings() -> dict[tuple, list[tuple[int, bool, Set]]]:
    """By (centring translations, rotations): (place in the list of 530 settings, whether its origin counts, operations) of the tabled settings.

    Settings of a monoclinic or orthorhombic group follow one another in the
    order of the exchanges of axes that make them, each once up to its origin.
    """
    out: dict[tuple, list] = {}
    for number, _, name, place, origins in rows_of():
        letter, operations = hall(name)
        full = [(r, (t + c) % 24) for r, t in operations for c in np.array(CENTRINGS[letter])]
        changes = [np.eye(3, dtype=int)]
        if 3 <= number <= 15:
            changes = [cycle @ choice @ sign for cycle in CYCLES for sign in SIGNED for choice in MONOCLINIC]
        elif 16 <= number <= 74:
            changes = ORTHORHOMBIC
        found = 0
        for p in changes:
            to = np.linalg.inv(p.T)
            where, one = located([(np.rint(to @ r @ p.T).astype(int), np.rint(to @ t).astype(int)) for r, t in full])
            listed, fixed = out.setdefault(where, []), origins > 1 or number in BY_ORIGIN
            before = [other for k, _, other in listed if place <= k < place + found * origins]
            if number in EVERY_EXCHANGE or not any(same_set(other, one) if number in BY_ORIGIN else same_origin(other, one, 0.01) for other in before):
                listed.append((place + found * origins, fixed, one))
                found += 1
    return out


def setting(full: list[tuple[np.ndarray, np.ndarray]]) -> int | None:
    """Place of a full set (translations in 24ths) among the settings, whatever its origin unless two origins are listed."""
    where, have = located(full)
    for place, fixed, wanted in settings().get(where, []):
        if same_set(wanted, have) if fixed else same_origin(wanted, have, 0.01):
            return place
    return None


def name_operations(texts: list[str]) -> tuple[int | None, str | None, int | None]:
    """(number, symbol, place among the 530 settings) of operations as written; None for what is not tabled."""
    parsed = [symmetry.parse(x, wide=True) for x in texts]
    full = {(p[0], symmetry.twentyfourths(p)) for p in parsed}
    found = identify([(np.array(r), np.array(t) / 24) for r, t in sorted(full)])
    return (*(found or (None, None)), setting([(np.array(r), np.array(t)) for r, t in full]) if found else None)


def records_of(texts: list[str]) -> tuple[int | None, list[str] | None]:
    """(lattice number, operations beside it) from which the full list follows; None where a centring has no lattice number."""
    try:
        return symmetry.symmetry_records(texts, wide=True)
    except ValueError:
        return None, None


def with_names(operations: DataFrame) -> DataFrame:
    """(structure_id, number, symbol, hall, lattice, records) of structures' full operations (structure_id, op).

    ``hall`` is the place among the 530 settings; ``lattice`` and ``records``
    are what a file of records needs to state. Structures with equal operations
    are named together: only distinct lists reach the matching. A structure with
    an operation that can't be read, or whose operations are no tabled group,
    has nulls.
    """
    import pandas as pd

    lists = operations.groupBy("structure_id").agg(F.array_sort(F.collect_set("op")).alias("ops"))

    def one(texts: list[str]) -> tuple:
        try:
            return *name_operations(texts), *records_of(texts)
        except ValueError:
            return (None,) * 5

    def run(batches):
        for pdf in batches:
            columns = list(zip(*[one(list(x)) for x in pdf["ops"]])) or [()] * 5
            kinds = ["Int32", object, "Int32", "Int32", object]
            yield pd.DataFrame({"ops": pdf["ops"]} | {n: pd.Series(c, dtype=k) for n, c, k in zip(["number", "symbol", "hall", "lattice", "records"], columns, kinds)})

    named = lists.select("ops").distinct().mapInPandas(run, "ops array<string>, number int, symbol string, hall int, lattice int, records array<string>")
    return lists.join(named, "ops", "left").drop("ops")


def expanding_back(named: DataFrame) -> DataFrame:
    """``named`` (lattice, records, ops) with ``expands_back``: whether the records expand to the operations in ``ops``; tried once for each distinct list."""
    keys = ["lattice", "records", "ops"]

    def run(batches):
        import pandas as pd

        for pdf in batches:
            found = []
            for lattice, records, texts in pdf.itertuples(index=False):
                full = {(p[0], symmetry.twentyfourths(p)) for p in (symmetry.parse(x, wide=True) for x in texts)}
                back = None if records is None else {(r, symmetry.twentyfourths((r, t))) for r, t in symmetry.full_operations(list(records), int(lattice), wide=True)}
                found.append(None if back is None else back == full)
            yield pdf.assign(expands_back=pd.array(found, "boolean"))

    tried = named.select(*keys).distinct().mapInPandas(run, "lattice int, records array<string>, ops array<string>, expands_back boolean")
    x, y = named.alias("x"), tried.alias("y")
    same = F.col("x.lattice").eqNullSafe(F.col("y.lattice")) & F.col("x.records").eqNullSafe(F.col("y.records")) & (F.col("x.ops") == F.col("y.ops"))
    return x.join(y, same).select("x.*", "y.expands_back")


def rebased(text: str, p: np.ndarray, shift: tuple[Fraction, ...] = (Fraction(0),) * 3) -> str:
    """An operation as written in the basis ``p @ old`` (p integer, of determinant 1) with the origin at ``shift`` (old basis)."""
    r, t = symmetry.parse(text, wide=True)
    r, to = np.array(r), lattices.inverse(p.T)
    moved = [x + sum(int(a) * s for a, s in zip(row, shift)) - s0 for x, row, s0 in zip(t, r, shift)]
    rotation = to @ r @ p.T
    return symmetry.written((_key(rotation), tuple(sum(int(a) * x for a, x in zip(row, moved)) for row in to)))
