"""tracewell: near-duplicate search and text analytics expressed as Spark plans."""

import sys

from pyspark import cloudpickle

# Python functions of this package travel to the executors by value, so a cluster needs
# no installed copy of it (numpy, pyarrow and the listed libraries are enough there).
cloudpickle.register_pickle_by_value(sys.modules[__name__])
