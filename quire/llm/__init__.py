"""Operators for preparing training data: deduplication, mixing, language, toxicity, sharding, tokens."""

import sys

from pyspark import cloudpickle

# Functions for Python workers travel with the job, as in the rest of the library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
