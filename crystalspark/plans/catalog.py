"""Registry of the engine's queries over the test tables, each beside its SQL.

The tables stand in for a crystal corpus (see ``operators.corpus``), a log
corpus (``events``), descriptors (``embeddings``) and stage chains
(``conversations``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from crystalspark.functions import geometry as g
from crystalspark.functions import text as t
from crystalspark.operators import bonded, bonds, calculations, cells, corpus, dims, pdd, results, symmetry, typing, zmatrix
from crystalspark.operators.corpus import SQL, table
from crystalspark.sources import writers

FLAGSHIP = "expand_cells"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def r6(c) -> F.Column:
    """Six decimals, without a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def lit_table(name: str, columns: str, rows: list[tuple]) -> str:
    return f"{name}({columns}) AS (VALUES {', '.join('(' + ', '.join(f'{x!r}::DOUBLE' if isinstance(x, float) else repr(x) for x in r) + ')' for r in rows)})"


def cart(spark, sf_dir) -> DataFrame:
    return corpus.with_cartesian(corpus.with_lattice(corpus.atoms(spark, sf_dir)))


def ops(spark) -> DataFrame:
    return symmetry.operations(spark, corpus.GROUPS)


ELEMENTS_SQL = lit_table("el", "element, radius, mass", [(k, v[1], v[2]) for k, v in dims.ELEMENTS.items()])
OPS_SQL = lit_table("ops", "sg, op_idx, op, r11, r12, r13, r21, r22, r23, r31, r32, r33, t1, t2, t3", symmetry.operation_rows(corpus.GROUPS))
PAIRS_SQL = lit_table("pc", "e1, e2, cutoff", [(*p, c) for a, c in dims.PAIR_CUTOFFS.items() for p in {a, a[::-1]}])
W_ = f"WITH RECURSIVE {SQL}"


def r0(c) -> F.Column:
    """Already rounded, without a negative zero."""
    return c + F.lit(0.0)


def cs(expr: str, name: str) -> str:
    return f"{expr} + 0.0 AS {name}"


def rs(expr: str, name: str) -> str:
    return f"round({expr}, 6) + 0.0 AS {name}"


# cells and coordinates


@query(f"{W_} SELECT DISTINCT structure_id, " + ", ".join(rs(f'"{c}"', f"m_{c}") for c in g.LATTICE) + " FROM cells")
def lattice_matrix(spark, sf_dir):
    return corpus.with_lattice(corpus.structures(spark, sf_dir)).select("structure_id", *[r6(c).alias(f"m_{c}") for c in g.LATTICE])


@query(f"{W_} SELECT structure_id, atom_idx, {rs('x', 'x')}, {rs('y', 'y')}, {rs('z', 'z')} FROM cart")
def frac_to_cart(spark, sf_dir):
    return cart(spark, sf_dir).select("structure_id", "atom_idx", *[r6(c).alias(c) for c in "xyz"])


@query(f"{W_} SELECT structure_id, atom_idx, {rs('fx', 'fx')}, {rs('fy', 'fy')}, {rs('fz', 'fz')} FROM cart")
def cart_to_frac(spark, sf_dir):
    f = g.to_fractional(tuple(F.col(c) for c in "xyz"))
    return cart(spark, sf_dir).select("structure_id", "atom_idx", *[r6(v).alias(n) for v, n in zip(f, ("fx", "fy", "fz"))])


def _canonical_sql(e: str) -> str:
    return f"round_even(CASE WHEN abs(({e}) - floor({e}) - 1) <= 1e-8 THEN 0 ELSE ({e}) - floor({e}) END, 8)"


@query(f"{W_} SELECT structure_id, atom_idx, {cs(_canonical_sql('1.25 - 3 * fx'), 'fx')}, {cs(_canonical_sql('fy - 2'), 'fy')}, {cs(_canonical_sql('-fz'), 'fz')} FROM atoms")
def canonical_frac(spark, sf_dir):
    a = corpus.atoms(spark, sf_dir)
    return a.select("structure_id", "atom_idx", *[r0(g.canonical(v)).alias(n) for v, n in ((1.25 - 3 * F.col("fx"), "fx"), (F.col("fy") - 2, "fy"), (-F.col("fz"), "fz"))])


_IMAGES = "im AS (SELECT a.structure_id, a.atom_idx, a.element, a.label, a.a, a.b, a.c, a.alpha, a.beta, a.gamma, o.op_idx, " + ", ".join(f"{_canonical_sql(f'o.r{k}1 * a.fx + o.r{k}2 * a.fy + o.r{k}3 * a.fz + o.t{k} / 24.0::DOUBLE')} AS g{x}" for k, x in ((1, "x"), (2, "y"), (3, "z"))) + " FROM cells a JOIN ops o USING (sg))"


@query(f"{W_}, {OPS_SQL}, {_IMAGES} SELECT structure_id, atom_idx, op_idx, gx + 0.0 AS gx, gy + 0.0 AS gy, gz + 0.0 AS gz FROM im")
def symop_apply(spark, sf_dir):
    return symmetry.apply(corpus.atoms(spark, sf_dir), ops(spark)).select("structure_id", "atom_idx", "op_idx", *[r0(F.col(c)).alias(c) for c in ("gx", "gy", "gz")])


@query(f"{W_}, {OPS_SQL}, {_IMAGES}, s AS (SELECT DISTINCT structure_id, element, gx, gy, gz FROM im) SELECT structure_id, element, count(*) AS n_sites FROM s GROUP BY ALL")
def expand_cells(spark, sf_dir):
    return symmetry.expand(corpus.atoms(spark, sf_dir), ops(spark)).groupBy("structure_id", "element").agg(F.count("*").alias("n_sites"))


@query(f"""{W_}, {OPS_SQL}, {_IMAGES}, s AS (SELECT *, row_number() OVER (PARTITION BY structure_id, element, gx, gy, gz ORDER BY atom_idx, op_idx) AS r FROM im)
SELECT structure_id, atom_idx, op_idx, label || '_' || row_number() OVER (PARTITION BY structure_id, label ORDER BY atom_idx, op_idx) AS site_label FROM s WHERE r = 1""")
def label_running_suffix(spark, sf_dir):
    return symmetry.expand(corpus.atoms(spark, sf_dir), ops(spark)).select("structure_id", "atom_idx", "op_idx", "site_label")


@query(f"{W_}, {OPS_SQL}, {_IMAGES}, s AS (SELECT DISTINCT structure_id, atom_idx, gx, gy, gz FROM im) SELECT structure_id, atom_idx, count(*) AS n_images FROM s GROUP BY ALL")
def expand_per_atom(spark, sf_dir):
    return symmetry.expand(corpus.atoms(spark, sf_dir), ops(spark), per_atom=True).groupBy("structure_id", "atom_idx").agg(F.count("*").alias("n_images"))


@query()
def merge_near_sites(spark, sf_dir):
    sites = symmetry.expand(corpus.atoms(spark, sf_dir), ops(spark))
    used = sites.select("structure_id", "atom_idx", "op_idx", "element", "gx", "gy", "gz", *cells.CELL)
    return cells.merge_sites(used).groupBy("structure_id").agg(F.count("*").alias("n_sites"))


@query(f"""{W_}, ct(latt, k, c1, c2, c3) AS (VALUES {', '.join(f'({n}, {k}, {c[0]}, {c[1]}, {c[2]})' for n, v in dims.CENTERINGS.items() for k, c in enumerate(v))})
SELECT structure_id, atom_idx, k, {cs(_canonical_sql('fx + c1 / 24.0::DOUBLE'), 'gx')}, {cs(_canonical_sql('fy + c2 / 24.0::DOUBLE'), 'gy')}, {cs(_canonical_sql('fz + c3 / 24.0::DOUBLE'), 'gz')} FROM atoms JOIN ct ON latt = structure_id % 7 + 1""")
def centering_expand(spark, sf_dir):
    rows = [(n, k, *c) for n, v in dims.CENTERINGS.items() for k, c in enumerate(v)]
    ct = F.broadcast(spark.createDataFrame(rows, "latt int, k int, c1 int, c2 int, c3 int"))
    a = corpus.atoms(spark, sf_dir).withColumn("latt", (F.col("structure_id") % 7 + 1).cast("int")).join(ct, "latt")
    return a.select("structure_id", "atom_idx", "k", *[r0(g.canonical(F.col(f"f{x}") + F.col(f"c{n}") / 24.0)).alias(f"g{x}") for n, x in ((1, "x"), (2, "y"), (3, "z"))])


@query(f"""WITH {OPS_SQL}, lt(sg, latt) AS (VALUES (0, 1), (1, 1), (2, 1), (3, 7)), ct(latt, k, c1, c2, c3) AS (VALUES {', '.join(f'({n}, {k}, {c[0]}, {c[1]}, {c[2]})' for n, v in dims.CENTERINGS.items() for k, c in enumerate(v))}),
mn AS (SELECT sg, op_idx, min((t1 - c1 + 24) % 24 * 576 + (t2 - c2 + 24) % 24 * 24 + (t3 - c3 + 24) % 24) AS m FROM ops JOIN lt USING (sg) JOIN ct USING (latt) GROUP BY ALL)
SELECT sg, count(DISTINCT (r11, r12, r13, r21, r22, r23, r31, r32, r33, m)) AS n FROM ops JOIN mn USING (sg, op_idx) GROUP BY sg""")
def symop_dedupe(spark, sf_dir):
    lattice = {0: 1, 1: 1, 2: 1, 3: 7}
    return spark.createDataFrame([(k, len(symmetry.distinct(v, lattice[k]))) for k, v in corpus.GROUPS.items()], "sg int, n long")


@query(f"""{W_}, p AS (SELECT a.*, b.atom_idx AS j, b.fx - a.fx AS d1, b.fy - a.fy AS d2, b.fz - a.fz AS d3 FROM cells a JOIN atoms b ON a.structure_id = b.structure_id AND a.atom_idx < b.atom_idx),
q AS (SELECT *, d1 - round_even(d1, 0) AS u, d2 - round_even(d2, 0) AS v, d3 - round_even(d3, 0) AS w FROM p)
SELECT structure_id, atom_idx AS i, j, {rs('sqrt((u*ax+v*bx+w*cx)**2 + (u*ay+v*"by"+w*cy)**2 + (u*az+v*bz+w*cz)**2)', 'distance')} FROM q""")
def min_image_distance(spark, sf_dir):
    both = bonds.pairs(corpus.with_lattice(corpus.atoms(spark, sf_dir)), ["fx", "fy", "fz"])
    f, h = (tuple(F.col(f"f{c}{k}") for c in "xyz") for k in (1, 2))
    return both.select("structure_id", "i", "j", r6(g.nearest_image(f, h)).alias("distance"))


# composition


@query(f"{W_} SELECT structure_id, element, count(*) AS n, min(atom_idx) AS first_idx FROM atoms GROUP BY ALL")
def element_composition(spark, sf_dir):
    return corpus.atoms(spark, sf_dir).groupBy("structure_id", "element").agg(F.count("*").alias("n"), F.min("atom_idx").alias("first_idx"))


_COMP = "cm AS (SELECT structure_id, string_agg(element || n, '' ORDER BY element) AS composition FROM (SELECT structure_id, element, count(*) AS n FROM atoms GROUP BY ALL) GROUP BY structure_id)"


def compositions(spark, sf_dir) -> DataFrame:
    each = corpus.atoms(spark, sf_dir).groupBy("structure_id", "element").agg(F.count("*").alias("n"))
    return each.groupBy("structure_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("element", "n"))), lambda x: F.concat(x["element"], x["n"].cast("string"))), "").alias("composition"))


@query(f"{W_}, {_COMP} SELECT a.structure_id, a.composition, coalesce(a.composition = b.composition, false) AS same_as_next FROM cm a LEFT JOIN cm b ON b.structure_id = a.structure_id + 1")
def composition_match(spark, sf_dir):
    c = compositions(spark, sf_dir)
    after = c.select((F.col("structure_id") - 1).alias("structure_id"), F.col("composition").alias("after"))
    return c.join(after, "structure_id", "left").select("structure_id", "composition", F.coalesce(F.col("composition") == F.col("after"), F.lit(False)).alias("same_as_next"))


# bonds and molecules

_SHIFTS = "sh AS (SELECT a.range AS sx, b.range AS sy, c.range AS sz FROM range(-1, 2) a, range(-1, 2) b, range(-1, 2) c)"
_BONDS = f"""{ELEMENTS_SQL}, {_SHIFTS}, ra AS (SELECT cart.*, radius, mass FROM cart JOIN el USING (element)),
nr AS (SELECT a.structure_id, a.atom_idx AS i, b.atom_idx AS j, a.element AS e1, b.element AS e2, sx, sy, sz, a.radius + b.radius AS total,
  sqrt((b.x - a.x + sx*a.ax + sy*a.bx + sz*a.cx)**2 + (b.y - a.y + sx*a.ay + sy*a."by" + sz*a.cy)**2 + (b.z - a.z + sx*a.az + sy*a.bz + sz*a.cz)**2) AS distance
  FROM ra a JOIN ra b ON a.structure_id = b.structure_id AND a.atom_idx < b.atom_idx CROSS JOIN sh),
bd AS (SELECT *, row_number() OVER (PARTITION BY structure_id, i, j ORDER BY distance, sx, sy, sz) AS r FROM nr WHERE distance <= total * CASE WHEN e1 = 'H' OR e2 = 'H' THEN 1.3 ELSE 1.2 END),
bonds AS (SELECT * FROM bd WHERE r = 1)"""


@query(f"{W_}, {_BONDS} SELECT structure_id, i, j, {rs('distance', 'distance')}, {rs('distance / total', 'ratio')} FROM bonds")
def bond_self_join(spark, sf_dir):
    return bonds.contacts(cart(spark, sf_dir)).select("structure_id", "i", "j", r6("distance").alias("distance"), r6("ratio").alias("ratio"))


@query()
def bond_shortest_per_h(spark, sf_dir):
    near = bonded.bond_rows(cart(spark, sf_dir), list("xyz"), lambda atoms: atoms.contacts().single_hydrogen())
    return near.select("structure_id", "i", "j", r6("distance").alias("distance"))


_TABLE_BONDS = f"""{PAIRS_SQL}, tp AS (SELECT a.structure_id, a.atom_idx AS i, b.atom_idx AS j, a.element AS e1, b.element AS e2, cutoff, a.ax, a.ay, a.az, a.bx, a."by", a.bz, a.cx, a.cy, a.cz,
  b.fx - a.fx - round_even(b.fx - a.fx, 0) AS u, b.fy - a.fy - round_even(b.fy - a.fy, 0) AS v, b.fz - a.fz - round_even(b.fz - a.fz, 0) AS w
  FROM cells a JOIN cells b ON a.structure_id = b.structure_id AND a.atom_idx < b.atom_idx JOIN pc ON pc.e1 = a.element AND pc.e2 = b.element),
tb AS (SELECT *, sqrt((u*ax+v*bx+w*cx)**2 + (u*ay+v*"by"+w*cy)**2 + (u*az+v*bz+w*cz)**2) AS distance FROM tp)"""


@query(f"{W_}, {_TABLE_BONDS} SELECT structure_id, i, j, {rs('distance', 'distance')} FROM tb WHERE distance < cutoff")
def bond_pair_cutoff_join(spark, sf_dir):
    near = bonds.pair_table_bonds(corpus.with_lattice(corpus.atoms(spark, sf_dir)))
    return near.select("structure_id", "i", "j", r6("distance").alias("distance"))


_PARTS = f"""{_BONDS}, ed AS (SELECT structure_id, i, j FROM bonds UNION ALL SELECT structure_id, j, i FROM bonds),
rc AS (SELECT structure_id, atom_idx, atom_idx AS k FROM atoms UNION SELECT rc.structure_id, rc.atom_idx, ed.j FROM rc JOIN ed ON ed.structure_id = rc.structure_id AND ed.i = rc.k),
parts AS (SELECT structure_id, atom_idx, min(k) AS component FROM rc GROUP BY ALL)"""


def found(spark, sf_dir, *fields: str, **how) -> DataFrame:
    """Structures with their atoms by molecule, bonds or molecules, as one row each."""
    return bonded.structures(cart(spark, sf_dir), *fields, **how)


def split(spark, sf_dir) -> DataFrame:
    """Atoms and their molecules."""
    return found(spark, sf_dir, "atoms").select("structure_id", F.inline("atoms"))


@query(f"{W_}, {_PARTS} SELECT structure_id, atom_idx, component FROM parts")
def connected_components(spark, sf_dir):
    return split(spark, sf_dir).select("structure_id", "atom_idx", "component")


@query(f"{W_}, {_PARTS}, ms AS (SELECT structure_id, component, count(*) AS n FROM parts GROUP BY ALL) SELECT structure_id, count(*) AS n_molecules, string_agg(CAST(n AS VARCHAR), ',' ORDER BY n DESC) AS sizes FROM ms GROUP BY ALL")
def molecule_sizes(spark, sf_dir):
    sizes = F.sort_array(F.transform("molecules", lambda m: m["n_atoms"]), False)
    return found(spark, sf_dir, "molecules").select("structure_id", F.size("molecules").cast("long").alias("n_molecules"), F.array_join(sizes.cast("array<string>"), ",").alias("sizes"))


_MOLS = f"""{_PARTS}, me AS (SELECT structure_id, component, element, count(*) AS n, sum(mass) AS m FROM parts JOIN atoms USING (structure_id, atom_idx) JOIN el USING (element) GROUP BY ALL),
mols AS (SELECT structure_id, component, CAST(sum(n) AS BIGINT) AS n_atoms, sum(m) AS weight, string_agg(element || n, '' ORDER BY element) AS formula FROM me GROUP BY ALL)"""


@query(f"{W_}, {_MOLS} SELECT structure_id, component, {rs('weight', 'weight')}, formula, CAST(row_number() OVER (PARTITION BY structure_id ORDER BY round(weight, 6) DESC, component) AS INT) AS place FROM mols")
def molecule_weight_order(spark, sf_dir):
    heaviest = F.array_sort(F.transform("molecules", lambda m: F.struct((-F.round(m["weight"], 6)).alias("w"), m["component"].alias("component"), m.alias("m"))))
    placed = found(spark, sf_dir, "molecules").select("structure_id", F.posexplode(heaviest).alias("place", "x"))
    return placed.select("structure_id", "x.component", r6("x.m.weight").alias("weight"), "x.m.formula", (F.col("place") + 1).alias("place"))


@query(f"{W_}, {_MOLS} SELECT structure_id, CAST(sum(CASE WHEN formula = 'H2O1' THEN 1 ELSE 0 END) AS BIGINT) AS n_water, CAST(sum(CASE WHEN formula <> 'H2O1' AND regexp_matches(formula, 'C[0-9]') THEN 1 ELSE 0 END) AS BIGINT) AS n_organic, count(*) AS n_all FROM mols GROUP BY ALL")
def water_vs_api(spark, sf_dir):
    n = lambda kind: F.size(F.filter("molecules", kind)).cast("long")
    water = lambda m: bonds.is_water(m["formula"])
    counts = n(water).alias("n_water"), n(lambda m: ~water(m) & m["formula"].rlike("C[0-9]")).alias("n_organic"), F.size("molecules").cast("long").alias("n_all")
    return found(spark, sf_dir, "molecules").select("structure_id", *counts)


_SIGN = f"""{_PARTS}, dg AS (SELECT structure_id, i AS atom_idx, count(*) AS degree FROM ed GROUP BY ALL),
l0 AS (SELECT a.structure_id, a.atom_idx, element || coalesce(degree, 0) AS label FROM atoms a LEFT JOIN dg USING (structure_id, atom_idx)),
""" + "".join(f"""a{k} AS (SELECT ed.structure_id, ed.i AS atom_idx, string_agg(label, ',' ORDER BY label) AS around FROM ed JOIN l{k - 1} l ON l.structure_id = ed.structure_id AND l.atom_idx = ed.j GROUP BY ALL),
l{k} AS (SELECT structure_id, atom_idx, md5(label || '|' || coalesce(around, '')) AS label FROM l{k - 1} LEFT JOIN a{k} USING (structure_id, atom_idx)),
""" for k in range(1, 8)) + f"""sg_ AS (SELECT structure_id, component, md5(string_agg(label, ',' ORDER BY label)) AS signature FROM l7 JOIN parts USING (structure_id, atom_idx) GROUP BY ALL)"""


@query(f"{W_}, {_SIGN} SELECT structure_id, component, min(component) OVER (PARTITION BY structure_id, signature) AS first_alike, count(*) OVER (PARTITION BY signature) AS alike FROM sg_")
def molecule_signature(spark, sf_dir):
    """Which molecules have one signature, in their structure and anywhere; the SQL refines for as many rounds as a structure here has atoms."""
    signed = bonds.signed_rows(found(spark, sf_dir, "atoms", "links"))
    alike = signed.groupBy("signature").agg(F.count("*").alias("alike"))  # summed up before it meets the rows
    first = F.min("component").over(W.partitionBy("structure_id", "signature"))
    return signed.withColumn("first_alike", first).join(alike, "signature").select("structure_id", "component", "first_alike", "alike")


@query(f"{W_}, {_SIGN} SELECT structure_id, min(component) AS representative, count(*) AS copies FROM sg_ GROUP BY structure_id, signature")
def molecule_dedupe(spark, sf_dir):
    return bonds.unique_molecules(bonds.signed_rows(found(spark, sf_dir, "atoms", "links"))).select("structure_id", "representative", "copies")


@query(f"{W_}, {_PARTS} SELECT structure_id, atom_idx, component, " + ", ".join(rs(f"{c} - avg({c}) OVER (PARTITION BY structure_id, component) + 10.0", c) for c in "xyz") + " FROM cart JOIN parts USING (structure_id, atom_idx)")
def gas_phase_center(spark, sf_dir):
    return bonds.boxed(split(spark, sf_dir)).select("structure_id", "atom_idx", "component", *[r6(c).alias(c) for c in "xyz"])


@query()
def molecules_unwrapped(spark, sf_dir):
    return found(spark, sf_dir, "atoms", unwrapped=True).select("structure_id", F.inline("atoms")).select("structure_id", "atom_idx", "component", *[r6(c).alias(c) for c in "xyz"])


# angles

_NEXT = "nx AS (SELECT structure_id, atom_idx, x AS x0, y AS y0, z AS z0, " + ", ".join(f"lead({c}, {k}) OVER w AS {c}{k}" for k in (1, 2, 3) for c in "xyz") + " FROM cart WINDOW w AS (PARTITION BY structure_id ORDER BY atom_idx))"


def leads(spark, sf_dir) -> DataFrame:
    w = W.partitionBy("structure_id").orderBy("atom_idx")
    return cart(spark, sf_dir).select("structure_id", "atom_idx", *[F.col(c).alias(f"{c}0") for c in "xyz"], *[F.lead(c, k).over(w).alias(f"{c}{k}") for k in (1, 2, 3) for c in "xyz"])


def point(k: int):
    return tuple(F.col(f"{c}{k}") for c in "xyz")


_ANGLE = """an AS (SELECT *, (x0-x1)*(x2-x1)+(y0-y1)*(y2-y1)+(z0-z1)*(z2-z1) AS d, sqrt((x0-x1)**2+(y0-y1)**2+(z0-z1)**2)*sqrt((x2-x1)**2+(y2-y1)**2+(z2-z1)**2) AS s FROM nx WHERE x2 IS NOT NULL),
ag AS (SELECT structure_id, atom_idx, CASE WHEN s < 1e-12 THEN -1 ELSE degrees(acos(greatest(-1, least(1, d / s)))) END AS angle FROM an)"""


@query(f"{W_}, {_NEXT}, {_ANGLE} SELECT structure_id, atom_idx, round(angle, 4) + 0.0 AS angle FROM ag")
def angles(spark, sf_dir):
    a = g.angle(point(0), point(1), point(2))
    return leads(spark, sf_dir).where("x2 IS NOT NULL").select("structure_id", "atom_idx", (F.round(F.nanvl(a, F.lit(-1.0)), 4) + 0.0).alias("angle"))


@query(f"{W_}, {_NEXT}, {_ANGLE} SELECT structure_id, atom_idx, round(CASE WHEN angle < 0 THEN -1 ELSE least(abs(angle), abs(180 - angle)) END, 4) + 0.0 AS margin FROM ag")
def linear_margin(spark, sf_dir):
    a = g.linear_margin(g.angle(point(0), point(1), point(2)))
    return leads(spark, sf_dir).where("x2 IS NOT NULL").select("structure_id", "atom_idx", (F.round(a, 4) + 0.0).alias("margin"))


_DIHEDRAL = """v0 AS (SELECT *, x0-x1 AS px, y0-y1 AS py, z0-z1 AS pz, x2-x1 AS qx, y2-y1 AS qy, z2-z1 AS qz, x3-x2 AS tx, y3-y2 AS ty, z3-z2 AS tz FROM nx WHERE x3 IS NOT NULL),
v1 AS (SELECT *, sqrt(qx*qx+qy*qy+qz*qz) AS l FROM v0), v2 AS (SELECT *, qx/l AS ux, qy/l AS uy, qz/l AS uz FROM v1 WHERE l >= 1e-12),
v3 AS (SELECT *, px*ux+py*uy+pz*uz AS dp, tx*ux+ty*uy+tz*uz AS dt FROM v2),
v4 AS (SELECT *, px-dp*ux AS vx, py-dp*uy AS vy, pz-dp*uz AS vz, tx-dt*ux AS wx, ty-dt*uy AS wy, tz-dt*uz AS wz FROM v3)"""


@query(f"""{W_}, {_NEXT}, {_DIHEDRAL} SELECT structure_id, atom_idx, round(degrees(atan2((uy*vz-uz*vy)*wx+(uz*vx-ux*vz)*wy+(ux*vy-uy*vx)*wz, vx*wx+vy*wy+vz*wz)), 4) + 0.0 AS dihedral FROM v4
WHERE sqrt(vx*vx+vy*vy+vz*vz) >= 1e-6 AND sqrt(wx*wx+wy*wy+wz*wz) >= 1e-6""")
def dihedrals(spark, sf_dir):
    b1 = g.minus(point(2), point(1))
    length = g.norm(b1)
    axis = tuple(F.try_divide(x, length) for x in b1)
    away = lambda v: g.norm(g.minus(v, tuple(g.dot(v, axis) * x for x in axis)))
    df = leads(spark, sf_dir).where("x3 IS NOT NULL").where((length >= 1e-12) & (away(g.minus(point(0), point(1))) >= 1e-6) & (away(g.minus(point(3), point(2))) >= 1e-6))
    return df.select("structure_id", "atom_idx", (F.round(g.dihedral(*map(point, range(4))), 4) + 0.0).alias("dihedral"))


# typing

_TYPES = f"""{_TABLE_BONDS}, te AS (SELECT structure_id, i AS atom_idx, e1 AS e, e2 AS o FROM tb WHERE distance < cutoff UNION ALL SELECT structure_id, j, e2, e1 FROM tb WHERE distance < cutoff),
tq AS (SELECT structure_id, atom_idx, count(*) AS n, min(o) AS parent FROM te WHERE e = 'H' AND o <> 'H' GROUP BY ALL),
ty AS (SELECT structure_id, atom_idx, element, CASE WHEN element <> 'H' THEN rpad(element, 3, '_') WHEN n = 1 AND parent IN ('C', 'S') THEN 'H_c' WHEN n = 1 AND parent = 'N' THEN 'H_n' WHEN n = 1 AND parent = 'O' THEN 'H_o' END AS site_type,
  CASE WHEN element = 'H' AND n IS NULL THEN 'no heavy neighbour' WHEN element = 'H' AND n > 1 THEN 'several heavy neighbours' WHEN element = 'H' AND parent NOT IN ('C', 'S', 'N', 'O') THEN 'unsupported neighbour' END AS error
  FROM atoms LEFT JOIN tq USING (structure_id, atom_idx))"""


def typed(spark, sf_dir):
    return typing.types(corpus.with_lattice(corpus.atoms(spark, sf_dir)))


@query(f"{W_}, {_TYPES} SELECT structure_id, atom_idx, element, site_type, error FROM ty")
def fit_types(spark, sf_dir):
    return typed(spark, sf_dir)


@query(f"{W_}, {_TYPES} SELECT DISTINCT site_type, structure_id FROM ty WHERE site_type IS NOT NULL AND site_type NOT IN ('C__', 'N__', 'O__', 'H_c', 'H_n', 'H_o')")
def fit_types_missing(spark, sf_dir):
    allowed = spark.createDataFrame([(x,) for x in ("C__", "N__", "O__", "H_c", "H_n", "H_o")], "site_type string")
    return typing.missing_types(typed(spark, sf_dir), allowed)


@query(f"{W_}, {_TYPES} SELECT structure_id, site_type, count(*) AS n FROM ty WHERE site_type IS NOT NULL GROUP BY ALL")
def type_counts(spark, sf_dir):
    return typing.type_counts(typed(spark, sf_dir))


# distance distributions

_KNN = f"""sh AS (SELECT x.range AS sx, y.range AS sy, z.range AS sz FROM range(-3, 4) x, range(-3, 4) y, range(-3, 4) z), kn AS (SELECT a.structure_id, a.atom_idx AS i, row_number() OVER (PARTITION BY a.structure_id, a.atom_idx ORDER BY sqrt((b.x - a.x + sx*a.ax + sy*a.bx + sz*a.cx)**2 + (b.y - a.y + sx*a.ay + sy*a."by" + sz*a.cy)**2 + (b.z - a.z + sx*a.az + sy*a.bz + sz*a.cz)**2)) - 1 AS rank,
  sqrt((b.x - a.x + sx*a.ax + sy*a.bx + sz*a.cx)**2 + (b.y - a.y + sx*a.ay + sy*a."by" + sz*a.cy)**2 + (b.z - a.z + sx*a.az + sy*a.bz + sz*a.cz)**2) AS distance
  FROM cart a JOIN cart b USING (structure_id) CROSS JOIN sh WHERE NOT (a.atom_idx = b.atom_idx AND sx = 0 AND sy = 0 AND sz = 0))"""


@query(f"{W_}, {_KNN} SELECT structure_id, i, CAST(rank AS INT) AS rank, {rs('distance', 'distance')} FROM kn WHERE rank < 4")
def pdd_knn(spark, sf_dir):
    return pdd.nearest(cart(spark, sf_dir), 4).select("structure_id", "i", "rank", r6("distance").alias("distance"))


@query()
def pdd_descriptors(spark, sf_dir):
    d = pdd.descriptors(cart(spark, sf_dir))
    return d.select("structure_id", "row_idx", "center_element", r6("weight").alias("weight"), F.transform("distances", lambda x: F.round(x, 6)).alias("distances"))


@query()
def pdd_emd(spark, sf_dir):
    place = F.row_number().over(W.partitionBy("composition").orderBy("structure_id")) - 1
    places = compositions(spark, sf_dir).select("structure_id", F.col("composition").alias("group"), place.alias("place"))
    return pdd.compared_in_order(places, cart(spark, sf_dir)).select("left_id", "right_id", "element", r6("distance").alias("distance"))


@query()
def site_assignment(spark, sf_dir):
    a = corpus.with_lattice(corpus.atoms(spark, sf_dir))
    moved = a.withColumns({"fx": F.col("fx") + 0.001, "fz": F.col("fz") + 1.0})
    return pdd.site_matching(a, moved).select("structure_id", "n", r6("max_distance").alias("max_distance"))


_EMB = "em AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"


@query(f"""WITH {_EMB}, un AS (SELECT vec_id, label, unnest(v) AS x, generate_subscripts(v, 1) AS k FROM em)
SELECT a.vec_id AS left_id, b.vec_id AS right_id, a.label, round(max(abs(a.x - b.x)), 6) + 0.0 AS distance FROM un a JOIN un b ON a.label = b.label AND a.k = b.k AND a.vec_id < b.vec_id GROUP BY ALL""")
def pdd_cost_matrix(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    return pdd.largest_differences(e, "label").select("left_id", "right_id", "label", r6("distance").alias("distance"))


@query(f"WITH {_EMB} SELECT vec_id, label, round(v[1], 6) + 0.0 AS d1, CAST(row_number() OVER (PARTITION BY label ORDER BY v, vec_id) AS INT) AS place, round(1.0::DOUBLE / count(*) OVER (), 9) AS weight FROM em")
def pdd_sorted(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    total = e.agg(F.count("*").alias("n"))
    place = F.row_number().over(W.partitionBy("label").orderBy("v", "vec_id"))
    return e.crossJoin(F.broadcast(total)).select("vec_id", "label", r6(F.col("v")[0]).alias("d1"), place.alias("place"), F.round(1.0 / F.col("n"), 9).alias("weight"))


# calculations

_CHAIN = """ev AS (SELECT user_id AS system, event_id, event_type, value, row_number() OVER w AS step, count(*) OVER (PARTITION BY user_id) AS calculations FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""


def chain(spark, sf_dir) -> DataFrame:
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("system"), "event_id", "event_type", "value", F.row_number().over(w).alias("step"), F.count("*").over(W.partitionBy("user_id")).alias("calculations"))


@query(f"""WITH {_CHAIN}, st AS (SELECT system, bool_or(event_type = 'error') AS fatal, bool_or(event_type = 'purchase') AS converged, bool_or(event_type = 'view') AS timing, max(CASE WHEN event_type = 'click' THEN value END) AS energy FROM ev GROUP BY system)
SELECT system, CASE WHEN fatal THEN 'failed' WHEN timing AND converged THEN 'completed_converged' WHEN timing THEN 'completed_unconverged' WHEN converged THEN 'completed_converged' WHEN energy IS NOT NULL THEN 'incomplete_or_running' ELSE 'unknown' END AS status FROM st""")
def calc_health_status(spark, sf_dir):
    e = chain(spark, sf_dir).groupBy("system").agg(*[F.bool_or(F.col("event_type") == k).alias(n) for k, n in (("error", "fatal"), ("purchase", "converged"), ("view", "timing"))], F.max(F.when(F.col("event_type") == "click", F.col("value"))).alias("energy"))
    status = calculations.health(F.col("fatal"), F.col("timing"), F.lit(False), F.col("converged"), F.col("energy"), F.lit(True))
    return e.select("system", status.alias("status"))


@query(f"WITH {_CHAIN} SELECT system, event_id, event_type, {rs('value', 'energy')}, CAST(step AS INT) AS step, calculations FROM ev WHERE step = calculations")
def calc_latest(spark, sf_dir):
    c = calculations.latest(chain(spark, sf_dir), "system", [F.desc("step")])
    return c.select("system", "event_id", "event_type", r6("value").alias("energy"), "step", "calculations")


@query(f"WITH {_CHAIN} SELECT system, string_agg(CAST(step AS VARCHAR), '.' ORDER BY step) AS chain FROM ev WHERE event_type = 'purchase' GROUP BY system")
def calc_chain_text(spark, sf_dir):
    c = chain(spark, sf_dir).where("event_type = 'purchase'").groupBy("system").agg(F.array_sort(F.collect_list("step")).cast("array<string>").alias("steps"))
    return c.select("system", t.chain_text(F.col("steps")).alias("chain"))


@query(f"WITH {_CHAIN}, f AS (SELECT system, max(step) AS step FROM ev WHERE event_type = 'purchase' GROUP BY system) SELECT ev.system, {rs('value', 'free_energy')}, CAST(ev.step AS VARCHAR) AS iteration FROM ev JOIN f ON f.system = ev.system AND f.step = ev.step")
def last_energy_line(spark, sf_dir):
    line = F.when(F.col("event_type") == "purchase", F.format_string("%d F= %s E0= %s", "step", F.col("value").cast("string"), F.col("value").cast("string"))).otherwise("iteration")
    logs = chain(spark, sf_dir).groupBy("system").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step", line.alias("l")))), lambda x: x["l"]), "\n").alias("log"))
    found = calculations.run_log(F.col("log"))
    return logs.select("system", found["free_energy"].alias("free_energy"), found["iteration"].alias("iteration")).where("free_energy IS NOT NULL").select("system", r6("free_energy").alias("free_energy"), "iteration")


@query("SELECT doc_id, regexp_matches(text, '(?i)\\bpassword\\b') OR regexp_matches(text, '(?i)\\bkilled\\b') OR regexp_matches(text, '(?im)^\\s*ERROR\\b') OR regexp_matches(text, '(?i)internal error') AS fatal FROM documents")
def fatal_markers(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", (F.col("text").rlike(r"(?i)\bpassword\b") | (F.size(t.fatal_markers(F.col("text"))) > 0)).alias("fatal"))


@query("""WITH s AS (SELECT conv_id, turn, length(text) AS n, lag(length(text)) OVER w AS before FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, string_agg(CASE WHEN before IS NOT NULL AND before <> n THEN CAST(turn AS VARCHAR) END, ',' ORDER BY turn) AS changed, min(CASE WHEN before IS NOT NULL AND before <> n THEN turn END) AS first_change, count(*) AS stages FROM s GROUP BY conv_id""")
def stage_change_lag(spark, sf_dir):
    w = W.partitionBy("conv_id").orderBy("turn")
    n = F.length("text")
    changed = F.lag(n).over(w) != n
    s = table(spark, sf_dir, "conversations").select("conv_id", "turn", changed.alias("changed")).groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("changed"), F.col("turn")))).alias("c"), F.min(F.when(F.col("changed"), F.col("turn"))).alias("first_change"), F.count("*").alias("stages")
    )
    return s.select("conv_id", F.nullif(F.array_join(F.col("c").cast("array<string>"), ","), F.lit("")).alias("changed"), "first_change", "stages")


@query("SELECT conv_id, " + ", ".join(f"max(CASE WHEN turn = {k} THEN length(text) END) AS stage_{k}" for k in range(4)) + ", string_agg(turn || ':' || length(text), ',' ORDER BY turn, length(text)) FILTER (WHERE turn > 3) AS later FROM conversations GROUP BY conv_id")
def stage_pivot(spark, sf_dir):
    """Lengths by stage: the first four as columns, any later ones listed."""
    length = F.length("text").cast("long")
    late = F.array_sort(F.collect_list(F.when((F.col("turn") > 3) & length.isNotNull(), F.struct("turn", length.alias("n")))))
    later = F.array_join(F.transform(late, lambda x: F.concat_ws(":", x["turn"].cast("string"), x["n"].cast("string"))), ",")
    stages = [F.max(F.when(F.col("turn") == k, length)).alias(f"stage_{k}") for k in range(4)]
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(*stages, F.nullif(later, F.lit("")).alias("later"))


_EXPECTED = ["click", "purchase", "view", "error", "scroll_depth"]


def _entries(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("system"), F.col("event_type").alias("filename"))


@query("WITH x(filename) AS (VALUES " + ", ".join(f"('{e}')" for e in _EXPECTED) + "), k AS (SELECT event_type AS filename, count(*) AS n FROM events GROUP BY ALL) SELECT coalesce(x.filename, k.filename) AS filename, coalesce(n, 0) AS n FROM x FULL OUTER JOIN k ON x.filename = k.filename")
def manifest_counts(spark, sf_dir):
    return calculations.manifest_counts(_entries(spark, sf_dir), _EXPECTED)


@query("WITH x(k, filename) AS (VALUES " + ", ".join(f"({i}, '{e}')" for i, e in enumerate(_EXPECTED)) + "), s AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS system FROM events), h AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS system, event_type AS filename FROM events) SELECT s.system, string_agg(x.filename, ',' ORDER BY k) AS missing FROM s CROSS JOIN x LEFT JOIN h ON h.system = s.system AND h.filename = x.filename WHERE h.filename IS NULL GROUP BY s.system")
def manifest_missing(spark, sf_dir):
    return calculations.manifest_missing(_entries(spark, sf_dir), _EXPECTED).select("system", F.array_join("missing", ",").alias("missing"))


# reports


@query("SELECT c_custkey AS identifier, round(c_acctbal, 6) AS x, round(o.total, 2) AS y, c_mktsegment = 'BUILDING' AS is_hydrate FROM customer JOIN (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY ALL) o ON o_custkey = c_custkey WHERE c_acctbal IS NOT NULL")
def results_points(spark, sf_dir):
    totals = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("identifier")).agg(F.sum("o_totalprice").alias("y"))
    c = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "identifier").join(totals, "identifier")
    found = results.points(c, "c_acctbal", "y", hydrate="c_mktsegment", exact="BUILDING")
    return found.select(F.col("identifier").cast("long").alias("identifier"), F.round("x", 6).alias("x"), F.round("y", 2).alias("y"), "is_hydrate")


@query("SELECT CASE WHEN s_suppkey % 17 = 3 THEN 'removed' ELSE 'kept' END AS side, count(*) AS n, round(sum(s_acctbal), 2) AS total FROM supplier GROUP BY ALL")
def outlier_split(spark, sf_dir):
    kept, removed = results.outliers(table(spark, sf_dir, "supplier"), F.col("s_suppkey") % 17 == 3)
    s = kept.withColumn("side", F.lit("kept")).union(removed.withColumn("side", F.lit("removed")))
    return s.groupBy("side").agg(F.count("*").alias("n"), F.round(F.sum("s_acctbal"), 2).alias("total"))


@query("WITH a AS (SELECT n_nationkey AS id, n_name AS label FROM nation WHERE n_nationkey % 3 <> 0), b AS (SELECT s_nationkey AS id, max(s_name) AS label FROM supplier WHERE s_nationkey % 2 = 0 GROUP BY ALL) SELECT coalesce(a.id, b.id) AS id, coalesce(b.label, a.label) AS label, a.id IS NOT NULL AS in_first, b.id IS NOT NULL AS in_second FROM a FULL OUTER JOIN b ON a.id = b.id")
def merge_two_sources_full_outer(spark, sf_dir):
    a = table(spark, sf_dir, "nation").where("n_nationkey % 3 <> 0").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("label"))
    b = table(spark, sf_dir, "supplier").where("s_nationkey % 2 = 0").groupBy(F.col("s_nationkey").alias("id")).agg(F.max("s_name").alias("label"))
    return results.merged(a, b, "id")


@query("SELECT c_custkey AS id, CASE WHEN c_acctbal < 0 THEN 'invalid energy' WHEN c_mktsegment = 'HOUSEHOLD' THEN 'notes present' WHEN o.n IS NULL THEN 'missing file' WHEN o.n < 5 THEN 'signature mismatch' ELSE 'generated' END AS reason FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY ALL) o ON o_custkey = c_custkey")
def reason_rule_chain(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    rule = results.reason({"invalid energy": F.col("c_acctbal") < 0, "notes present": F.col("c_mktsegment") == "HOUSEHOLD", "missing file": F.col("n").isNull(), "signature mismatch": F.col("n") < 5}, "generated")
    return table(spark, sf_dir, "customer").join(o, "c_custkey", "left").select(F.col("c_custkey").alias("id"), rule.alias("reason"))


@query("SELECT o_orderkey AS id, o_totalprice / (o_orderkey % 4 + 1) * 96.485 AS kj_per_mol FROM orders")
def energy_per_z(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / (F.col("o_orderkey") % 4 + 1) * 96.485).alias("kj_per_mol"))


@query(f"""{W_}, dt AS (SELECT DISTINCT structure_id, ax, ay, az, bx, "by", bz, cx, cy, cz, ax * ("by" * cz - bz * cy) + ay * (bz * cx - bx * cz) + az * (bx * cy - "by" * cx) AS v FROM cells)
SELECT structure_id, {', '.join(f"CAST(greatest(1, ceil(round(2 * pi() / v * sqrt({e}) / {writers.SPACING!r}, 9))) AS INT) AS k{n}" for n, e in ((1, '("by"*cz-bz*cy)**2+(bz*cx-bx*cz)**2+(bx*cy-"by"*cx)**2'), (2, '(cy*az-cz*ay)**2+(cz*ax-cx*az)**2+(cx*ay-cy*ax)**2'), (3, '(ay*bz-az*"by")**2+(az*bx-ax*bz)**2+(ax*"by"-ay*bx)**2')))} FROM dt""")
def kpoint_grid(spark, sf_dir):
    s = corpus.with_lattice(corpus.structures(spark, sf_dir))
    return s.select("structure_id", *[c.alias(f"k{i}") for i, c in enumerate(writers.kpoint_grid(), 1)])


@query()
def poscar_text(spark, sf_dir):
    return writers.poscar(cart(spark, sf_dir)).select("structure_id", "text")


@query()
def cif_text(spark, sf_dir):
    return writers.cif(corpus.atoms(spark, sf_dir))


@query()
def res_text(spark, sf_dir):
    latt = F.element_at(F.array(*[F.lit(symmetry.symmetry_records(corpus.GROUPS[k])[0]) for k in range(4)]), F.col("sg") + 1)
    kept = F.element_at(F.array(*[F.array(*[F.lit(symmetry.written(symmetry.parse(o))) for o in symmetry.symmetry_records(corpus.GROUPS[k])[1]]).cast("array<string>") for k in range(4)]), F.col("sg") + 1)
    return writers.res(corpus.atoms(spark, sf_dir), latt, kept)


@query(f"{W_}, l AS (SELECT element, atom_idx FROM atoms WHERE structure_id % 2 = 0), r AS (SELECT element, atom_idx FROM atoms WHERE structure_id % 2 = 1), x AS (SELECT 'left' AS side, * FROM (SELECT * FROM l EXCEPT ALL SELECT * FROM r) UNION ALL SELECT 'right', * FROM (SELECT * FROM r EXCEPT ALL SELECT * FROM l)) SELECT side, element, atom_idx, count(*) AS n FROM x GROUP BY ALL")
def multiset_difference(spark, sf_dir):
    a = corpus.atoms(spark, sf_dir)
    left, right = (a.where(F.col("structure_id") % 2 == k).select("element", "atom_idx") for k in (0, 1))
    both = left.exceptAll(right).withColumn("side", F.lit("left")).union(right.exceptAll(left).withColumn("side", F.lit("right")))
    return both.groupBy("side", "element", "atom_idx").agg(F.count("*").alias("n"))


@query("WITH a AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderstatus = 'O') SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'missing left' WHEN b.id IS NULL THEN 'missing right' ELSE 'paired' END AS state FROM a FULL OUTER JOIN b ON a.id = b.id")
def path_pairing_full_outer(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    a, b = (o.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("id")) for s in "FO")
    return results.paired(a, b, "id")


@query("SELECT l_orderkey AS structure_id, l_linenumber AS line, l_discount AS occupancy, count(*) AS n FROM lineitem WHERE l_discount < 0.05 GROUP BY ALL")
def partial_occupancy_filter(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").where(F.col("l_discount") < 0.05)
    return li.groupBy(F.col("l_orderkey").alias("structure_id"), F.col("l_linenumber").alias("line"), F.col("l_discount").alias("occupancy")).agg(F.count("*").alias("n"))


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN (p_partkey % 7) / 8.0::DOUBLE ELSE p_partkey + 0.5 END AS number, regexp_replace(trim(p_name), '\\s+', '_', 'g') AS safe, regexp_extract(p_brand, '^([A-Za-z]+)', 1) AS letters, p_partkey % 2 = 0 AS flag FROM part""")
def text_scalars(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    raw = F.when(key % 3 == 0, F.concat((key % 7).cast("string"), F.lit("/8"))).otherwise(F.concat(F.lit("'"), key.cast("string"), F.lit(".5(4)'")))
    flag = t.to_flag(F.when(key % 2 == 0, "'Yes'").otherwise("n"), False)
    return p.select(key.alias("id"), t.to_float(raw).alias("number"), t.safe_name(F.col("p_name")).alias("safe"), t.element_of_label(F.col("p_brand")).alias("letters"), flag.alias("flag"))


def zrows(spark, sf_dir) -> DataFrame:
    """A chain Z-matrix of each structure's atoms."""
    k = F.col("atom_idx")
    a = corpus.atoms(spark, sf_dir)
    ref = lambda n: F.when(k >= n, k - n + 1).cast("int")
    return a.select(
        F.col("structure_id").cast("string").alias("mol_id"), (k + 1).alias("row_index"), "element", ref(1).alias("bond_to"), F.when(k >= 1, 1.0 + F.col("fx")).alias("bond_length"),
        ref(2).alias("angle_to"), F.when(k >= 2, 60.0 + 100.0 * F.col("fy")).alias("angle_deg"), ref(3).alias("dihedral_to"), F.when(k >= 3, 360.0 * F.col("fz") - 180.0).alias("dihedral_deg"),
    )


@query(f"{W_} SELECT CAST(structure_id AS VARCHAR) AS mol_id, atom_idx + 1 AS row_index, CASE WHEN atom_idx >= 1 AND fx < 0.1 THEN 'length not positive' ELSE '' END AS errors FROM atoms")
def zmat_validate(spark, sf_dir):
    rows = zrows(spark, sf_dir).withColumn("bond_length", F.when(F.col("bond_length") < 1.1, -1.0).otherwise(F.col("bond_length")))
    return zmatrix.problems(rows).select("mol_id", "row_index", F.array_join("errors", ";").alias("errors"))


@query()
def zmat_reconstruct(spark, sf_dir):
    return zmatrix.cartesian(zrows(spark, sf_dir)).select("mol_id", "row_index", "element", *[r6(c).alias(c) for c in "xyz"])


@query(f"{W_} SELECT CAST(structure_id AS VARCHAR) AS mol_id, atom_idx + 1 AS row_index, round(1.0 + fx, 5) AS bond_length, round(CASE WHEN atom_idx >= 2 THEN 60.0 + 100.0 * fy END, 3) AS angle_deg FROM atoms WHERE atom_idx >= 1")
def zmat_measure(spark, sf_dir):
    rows = zrows(spark, sf_dir)
    m = zmatrix.measured(rows, zmatrix.cartesian(rows)).where("row_index > 1")
    return m.select("mol_id", "row_index", F.round("bond_length", 5).alias("bond_length"), F.round("angle_deg", 3).alias("angle_deg"))


@query(f"{W_} SELECT CAST(structure_id AS VARCHAR) AS mol_id, atom_idx + 1 AS row_index, CASE WHEN structure_id % 2 = 0 THEN 'proper' ELSE 'fallback' END AS kind FROM atoms WHERE atom_idx >= 3")
def dihedral_kind(spark, sf_dir):
    rows = zrows(spark, sf_dir)
    links = rows.where("bond_to IS NOT NULL AND cast(mol_id AS bigint) % 2 = 0").select("mol_id", F.col("bond_to").alias("a"), F.col("row_index").alias("b"))
    return zmatrix.dihedral_kinds(rows, links).select("mol_id", "row_index", "kind")


@query()
def zmat_generate(spark, sf_dir):
    z = zmatrix.generate_rows(found(spark, sf_dir, "atoms", "links", unwrapped=True))
    return z.select("structure_id", "component", "row_index", "element", "bond_to", r6("bond_length").alias("bond_length"), "angle_to", "dihedral_to", F.size("warnings").alias("n_warnings"))


@query()
def viewer_payload(spark, sf_dir):
    rows = zrows(spark, sf_dir)
    return zmatrix.viewer_payload(rows, zmatrix.cartesian(rows))


@query()
def reduce_to_asymmetric_unit(spark, sf_dir):
    sites = symmetry.expand(corpus.atoms(spark, sf_dir), ops(spark))
    full = sites.drop("fx", "fy", "fz", "label", "atom_idx", "op_idx").withColumnsRenamed({"gx": "fx", "gy": "fy", "gz": "fz", "site_label": "label"})
    full = full.select("structure_id", (F.row_number().over(W.partitionBy("structure_id").orderBy("label")) - 1).alias("atom_idx"), "label", "element", "fx", "fy", "fz", "a", "b", "c", "alpha", "beta", "gamma")
    return cells.reduce_cells(full).groupBy("structure_id").agg(F.count("*").alias("n_unique"), F.max("n_operations").alias("n_operations"))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
