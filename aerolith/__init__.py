"""Aerolith: aerial-survey analytics on PySpark DataFrames.

Functions that run in Python workers travel by value, so executors need no
copy of this package on their own path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
