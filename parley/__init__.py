"""parley: PySpark-native analytics for meeting transcripts and time-aligned signals."""

import sys

from pyspark import cloudpickle

# Python kernels travel with the task by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
