"""Offer matching and comparison as Spark jobs: DataFrames in, DataFrames out."""

import sys

from pyspark import cloudpickle

# The few functions that run inside Python tasks travel with the job, so
# executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
