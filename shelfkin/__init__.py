"""Content-based product recommendation on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions sent to tasks carry this package's code with them, so executors need no
# installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
