"""Sieveline: code-quality analytics and corpus preparation as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

# Python functions travel to the executors whole, which then need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
