"""Record reconciliation and corpus preparation as Spark DataFrame jobs.

Functions that run in Python workers are pickled by value, so that executors need no copy of this package on their path.
"""

from pyspark import cloudpickle as _cloudpickle

_cloudpickle.register_pickle_by_value(__import__(__name__))

__all__ = ["functions", "operators", "plans", "sources", "streaming"]
