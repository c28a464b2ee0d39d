"""assayer: tabular evidence operators for Spark DataFrames of any size."""

import sys

from pyspark import cloudpickle

# Functions for the workers travel with their code, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
