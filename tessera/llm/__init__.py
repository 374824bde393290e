"""Operators for preparing language-model training corpora.

Nothing else in the library imports this subpackage.  Its functions are
shipped to executors by value, so a cluster needs no installed copy.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
