"""Spark-native engine for labelled-text datasets.

Importing the package sets PySpark's serialiser to send the package's own
functions to the workers by value, so a query runs from any working directory
and needs no package files on the executors.
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
