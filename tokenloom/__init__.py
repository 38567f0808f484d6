"""Corpus tokenization and runtime analytics as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions and data sources of this package travel to the executors with the
# job itself, so nothing has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
