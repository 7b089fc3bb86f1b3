"""Sky-tile analytics and corpus processing as plain PySpark DataFrame programs."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors inside the closures that use them,
# so a cluster needs no installed copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
