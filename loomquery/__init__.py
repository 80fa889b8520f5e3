"""A PySpark-native engine for searching and studying collections of code and text."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to Python workers by value, so a cluster
# does not need the package installed on every node.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
