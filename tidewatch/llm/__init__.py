"""Training-data operators. Nothing else in the library imports this subpackage."""
import sys

from pyspark import cloudpickle

# workers get these functions by value, so they need no copy of the package on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])
