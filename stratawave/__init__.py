"""Regime and shock analytics as Spark DataFrame operators.

Every operator takes and returns DataFrames, runs no action of its own and
handles many series, indices and model keys in one job.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# The small functions that run inside tasks travel with the job, so executors
# need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
