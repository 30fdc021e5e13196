"""Spark-native retail price analytics: sources, functions, operators, plans and streams."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Functions that tasks run travel by value, so executors need no copy of this package.
register_pickle_by_value(sys.modules[__name__])
