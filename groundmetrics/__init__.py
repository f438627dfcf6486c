"""Referential-grounding analytics on PySpark: DataFrame in, DataFrame out."""

import sys

from pyspark import cloudpickle

from groundmetrics.session import checkpointed, get_session

# Functions of this package travel to the executors by value, so clusters need no extra install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["checkpointed", "get_session"]
