"""Operators of a training-data pipeline. Nothing outside this folder imports it.

Functions that Spark runs in Python workers are shipped by value, so executors need
no copy of this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
