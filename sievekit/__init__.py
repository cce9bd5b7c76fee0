"""Spark-native auditing and evaluation of labelled datasets."""

import sys

from pyspark import cloudpickle

# Functions go to the executors by value, so that these don't need the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
