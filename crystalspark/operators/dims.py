"""Constant tables. All are small and of fixed size, so they are broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Symbol, in order of atomic number: covalent radius in Angstrom (Cordero et al., 2008), standard atomic weight (fixed values).
ATOMS = {
    "H": (0.31, 1.008), "He": (0.28, 4.0026), "Li": (1.28, 6.94), "Be": (0.96, 9.0122), "B": (0.84, 10.81), "C": (0.76, 12.011),
    "N": (0.71, 14.007), "O": (0.66, 15.999), "F": (0.57, 18.998), "Ne": (0.58, 20.18), "Na": (1.66, 22.99), "Mg": (1.41, 24.305),
    "Al": (1.21, 26.982), "Si": (1.11, 28.085), "P": (1.07, 30.974), "S": (1.05, 32.06), "Cl": (1.02, 35.45), "Ar": (1.06, 39.948),
    "K": (2.03, 39.098), "Ca": (1.76, 40.078), "Sc": (1.7, 44.956), "Ti": (1.6, 47.867), "V": (1.53, 50.942), "Cr": (1.39, 51.996),
    "Mn": (1.39, 54.938), "Fe": (1.32, 55.845), "Co": (1.26, 58.933), "Ni": (1.24, 58.693), "Cu": (1.32, 63.546), "Zn": (1.22, 65.38),
    "Ga": (1.22, 69.723), "Ge": (1.2, 72.63), "As": (1.19, 74.922), "Se": (1.2, 78.971), "Br": (1.2, 79.904), "Kr": (1.16, 83.798),
    "Rb": (2.2, 85.468), "Sr": (1.95, 87.62), "Y": (1.9, 88.906), "Zr": (1.75, 91.224), "Nb": (1.64, 92.906), "Mo": (1.54, 95.95),
    "Tc": (1.47, 97.0), "Ru": (1.46, 101.07), "Rh": (1.42, 102.91), "Pd": (1.39, 106.42), "Ag": (1.45, 107.87), "Cd": (1.44, 112.41),
    "In": (1.42, 114.82), "Sn": (1.39, 118.71), "Sb": (1.39, 121.76), "Te": (1.38, 127.6), "I": (1.39, 126.904), "Xe": (1.4, 131.29),
    "Cs": (2.44, 132.91), "Ba": (2.15, 137.33), "La": (2.07, 138.91), "Ce": (2.04, 140.12), "Pr": (2.03, 140.91), "Nd": (2.01, 144.24),
    "Pm": (1.99, 145.0), "Sm": (1.98, 150.36), "Eu": (1.98, 151.96), "Gd": (1.96, 157.25), "Tb": (1.94, 158.93), "Dy": (1.92, 162.5),
    "Ho": (1.92, 164.93), "Er": (1.89, 167.26), "Tm": (1.9, 168.93), "Yb": (1.87, 173.05), "Lu": (1.87, 174.97), "Hf": (1.75, 178.49),
    "Ta": (1.7, 180.95), "W": (1.62, 183.84), "Re": (1.51, 186.21), "Os": (1.44, 190.23), "Ir": (1.41, 192.22), "Pt": (1.36, 195.08),
    "Au": (1.36, 196.97), "Hg": (1.32, 200.59), "Tl": (1.45, 204.38), "Pb": (1.46, 207.2), "Bi": (1.48, 208.98), "Po": (1.4, 209.0),
    "At": (1.5, 210.0), "Rn": (1.5, 222.0), "Fr": (2.6, 223.0), "Ra": (2.21, 226.0), "Ac": (2.15, 227.0), "Th": (2.06, 232.04),
    "Pa": (2.0, 231.04), "U": (1.96, 238.03), "Np": (1.9, 237.0), "Pu": (1.87, 244.0), "Am": (1.8, 243.0), "Cm": (1.69, 247.0),
}
#: Traversal priority of an element; others have 7 (fixed values).
PRIORITY = {"C": 0, "O": 1, "N": 2, "S": 3, "F": 4, "Cl": 5, "Br": 6, "H": 99}
#: Symbol: atomic number, covalent radius, atomic weight, traversal priority.
ELEMENTS = {symbol: (number, *values, PRIORITY.get(symbol, 7)) for number, (symbol, values) in enumerate(ATOMS.items(), 1)}

#: Longest bonds of element pairs in Angstrom (fixed values).
PAIR_CUTOFFS = {
    ("H", "C"): 1.2, ("H", "N"): 1.2, ("H", "O"): 1.3, ("H", "S"): 1.4, ("C", "C"): 1.7, ("C", "N"): 1.7, ("C", "O"): 1.5, ("C", "F"): 1.5, ("C", "Si"): 2.0, ("C", "S"): 2.0,
    ("C", "Cl"): 1.9, ("C", "I"): 2.3, ("C", "Cs"): 2.0, ("N", "N"): 1.7, ("N", "O"): 1.7, ("N", "S"): 1.75, ("N", "Cl"): 2.0, ("O", "S"): 1.7, ("S", "S"): 2.2,
}

#: Centring translations in 24ths of the cell by lattice number (fixed values).
CENTERINGS = {
    1: [(0, 0, 0)],
    2: [(0, 0, 0), (12, 12, 12)],
    3: [(0, 0, 0), (16, 8, 8), (8, 16, 16)],
    4: [(0, 0, 0), (0, 12, 12), (12, 0, 12), (12, 12, 0)],
    5: [(0, 0, 0), (0, 12, 12)],
    6: [(0, 0, 0), (12, 0, 12)],
    7: [(0, 0, 0), (12, 12, 0)],
}
LATTICE_LETTERS = {"P": 1, "I": 2, "R": 3, "F": 4, "A": 5, "B": 6, "C": 7}


def elements(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in ELEMENTS.items()], "element string, number int, radius double, mass double, priority int")


def known(df: DataFrame, column: str, element: str = "element") -> Column:
    """A property that was left-joined by element; an element without it raises instead of losing its atoms."""
    return F.coalesce(column, F.raise_error(F.concat(F.lit(f"no {column} is known for element "), F.coalesce(element, F.lit("(null)")))).cast(dict(df.dtypes)[column])).alias(column)


def pair_cutoffs(spark: SparkSession) -> DataFrame:
    """(e1, e2, cutoff) in both orders."""
    rows = {(*sorted(p), c) for p, c in PAIR_CUTOFFS.items()}
    return spark.createDataFrame(sorted(rows | {(b, a, c) for a, b, c in rows}), "e1 string, e2 string, cutoff double")
