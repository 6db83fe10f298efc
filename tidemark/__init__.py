"""tidemark: market-panel analytics and training-data operators on Spark."""

import sys

from pyspark import cloudpickle

# Python functions sent to executors travel by value, so a job needs no package shipping.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
