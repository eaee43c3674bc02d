"""Operators for preparing training text.

Nothing else in the library imports this subpackage; it can be removed whole.
"""

from pyspark import cloudpickle

from . import common  # noqa: F401

# Functions of this package travel to the executors by value, so that a cluster
# needs no copy of the repository on its Python path.
import sys as _sys

cloudpickle.register_pickle_by_value(_sys.modules[__name__])
