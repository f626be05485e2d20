"""gleanspark: text retrieval, text mining and training-data operators as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

# Functions that go to Python workers travel by value: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
