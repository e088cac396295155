"""weftline: Spark-native preparation, mixing and evaluation of multilingual text corpora."""

import sys

from pyspark import cloudpickle

# Functions shipped to executors travel by value, so a cluster needs no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
