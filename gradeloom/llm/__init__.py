"""Operators for preparing training text. Nothing else in the library imports this folder."""

import sys

from pyspark import cloudpickle

# The folder may not be installed on the executors; its functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
