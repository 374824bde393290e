"""A library for text retrieval, text quality and corpus preparation on Spark.

Its functions are shipped to executors by value, so a cluster needs no installed copy.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
