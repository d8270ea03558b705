"""memspan: a Spark-native analytics engine for agent-memory data."""

import sys

from pyspark import cloudpickle

# Worker-side functions travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
