"""A Spark-native engine for customer segmentation studies and corpus preparation."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers travel by value: executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
