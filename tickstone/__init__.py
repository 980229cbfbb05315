"""Tickstone: point-in-time analytics and data preparation as PySpark DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# functions run by Python workers travel with their code, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
