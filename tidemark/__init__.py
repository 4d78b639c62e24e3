"""Metric reconciliation and corpus preparation on Spark.

Executors receive the package's Python code by value, so they need no installed copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
