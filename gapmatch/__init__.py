"""Evidence matching, retrieval and scoring over document collections, as PySpark DataFrames."""

import sys

from pyspark import cloudpickle

# Task code travels with the job, so executors need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
