"""Spark-native document embedding and vector retrieval.

Every operator takes DataFrames and keyword arguments and returns a DataFrame.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions of this package that run inside tasks travel with the job, so executors
# need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
