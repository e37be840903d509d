"""Spark-native code search, duplicate mining, call graph and ranking."""
import sys

from pyspark import cloudpickle

# Worker functions travel with their code, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
