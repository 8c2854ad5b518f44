"""numera: operators on integers, bits and texts as Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors with the query, so that a
# cluster needs no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
