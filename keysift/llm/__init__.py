"""Operators of a training-data pipeline: ten of them, each by one published method.

Functions that run inside Python workers are sent by value, so executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
