"""Operators for training-data pipelines over documents, pages and vectors.

Functions that run inside tasks are sent by value, so executors need no copy of
this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
