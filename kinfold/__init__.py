"""Feature-table analytics as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with their job, so executors need no
# installation of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
