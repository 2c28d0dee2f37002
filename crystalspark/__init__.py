"""Spark-native analytics over corpora of molecular-crystal structures.

Structures, atoms, bonds, molecules, internal coordinates and calculation
logs are relations keyed by ``structure_id``; every operator takes and returns
DataFrames.
"""

import sys

import pyspark.cloudpickle as _cloudpickle

# Workers get this package's functions with the tasks and need no copy of it.
_cloudpickle.register_pickle_by_value(sys.modules[__name__])
