"""Hyperloom: formula-hypergraph queries and record pipelines on PySpark."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions that Python workers run travel by value, so executors need no installation of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
