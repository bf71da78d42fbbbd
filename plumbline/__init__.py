"""Data quality, drift, feature, text and model analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel by value, so executors need no copy of
# this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
