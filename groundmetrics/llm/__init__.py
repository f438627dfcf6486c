"""Operators for training-data pipelines. Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Tasks get the functions of this subpackage by value, so executors need no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
