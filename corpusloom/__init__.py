"""Spark-native analytics for building, cleaning and checking text corpora.

Worker-side Python functions of this package are pickled by value, so executors
need only the third-party libraries, never a copy of the package itself.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

register_pickle_by_value(sys.modules[__name__])
