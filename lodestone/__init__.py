"""Search-corpus analytics on Spark DataFrames.

Functions that run in Python workers travel with their code, so executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
