"""Loomwork: a PySpark-native engine for conversation and text data.

Sub-packages
------------
sources    readers and writers with explicit schemas
functions  column expressions (text, time, arithmetic)
operators  DataFrame -> DataFrame operators
plans      registered queries over the project's tables, with their SQL twins
streaming  Structured Streaming versions of the incremental operators
llm        operators for training-data preparation (optional, self-contained)
"""

__version__ = "0.1.0"

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions that run in Python workers travel by value, so executors need no copy of the package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
