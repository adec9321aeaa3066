"""Spark library for labelled, categorised sequences: preparing, scoring, evaluating."""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel with the task, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
