"""Discourse analysis of large multilingual text corpora on Spark."""

import sys

from pyspark import cloudpickle

# Functions given to Spark travel by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
