"""Spark-native analytics engine for noisy product-label text."""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel by value, so that executors need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
