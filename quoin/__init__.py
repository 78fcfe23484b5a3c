"""quoin: arrangements of oriented points as Spark DataFrames, and corpus preparation."""

import sys

from pyspark import cloudpickle

# functions travel to the executors with their code, so the package needn't be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
