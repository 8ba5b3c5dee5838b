"""Spark-native analytics for tables of single-read variant observations."""

import sys

from pyspark import cloudpickle

# Functions go to the Python workers as they are, so a cluster needs no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
