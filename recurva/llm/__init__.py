"""Operators for training-data pipelines: cleaning, deduplication, scoring, mixing, tokens, archives and vectors."""

import sys

from pyspark import cloudpickle

# Executors get the code of the functions themselves, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
