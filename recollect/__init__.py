"""Subject-memory jobs as Spark DataFrame operations."""

from pyspark import cloudpickle as _cloudpickle
import sys as _sys

# Functions run on executors travel with the job; nothing has to be installed there.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
