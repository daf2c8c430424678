"""Operators of a training-data pipeline: cleaning, deduplication, tokens, packing, search.

Executors get the functions of this package by value, so only the libraries have to be
installed there.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
