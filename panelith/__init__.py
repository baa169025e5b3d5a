"""Panel analytics on Spark: lazy factors over (timestamp, symbol) grids, compiled to DataFrame plans."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel whole, so executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
