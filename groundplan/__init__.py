"""Document retrieval and programme-controls analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# functions that run in Python workers travel with the job, so that executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
