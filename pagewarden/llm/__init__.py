"""Operators for building a training corpus out of crawled pages and texts."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors whole, so a cluster needs no copy
# of it in its Python path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
