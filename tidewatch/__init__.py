"""Scheduled-job health analytics on Spark DataFrames."""
import sys

from pyspark import cloudpickle

# workers get the package's functions by value, so they need no copy of it on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])
