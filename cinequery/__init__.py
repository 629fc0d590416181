"""Media-container and frame analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions of this package travel with the tasks, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
