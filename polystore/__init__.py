"""A PySpark-native multi-model analytics engine."""

import sys

from pyspark import cloudpickle

# Python functions of this package travel to the executors by value, which need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
