"""Usage, cost, quality and capacity analytics as Spark jobs: tables in, tables out."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# The few functions that run in Python workers travel with the job, so that executors do not need
# this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
