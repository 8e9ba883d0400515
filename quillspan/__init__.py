"""Quillspan: evidence-bound text analytics on Spark DataFrames.

Python functions of this package travel to the executors by value, so a cluster needs no installed copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
