"""tidemark keeps a derived document collection in step with its sources, on Spark."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# functions travel to executors by value, so a cluster needs no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
