"""Operators for training data: tokenising, packing, search, scoring, filtering and near-duplicates.

Nothing outside this folder imports it. Functions of this package travel to the executors by value, so these need no
copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
