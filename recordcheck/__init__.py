"""PySpark-native checking and cleaning of bibliographic records."""

import sys

from pyspark import cloudpickle

# Executors get this package's functions inside the tasks, so the package need not be installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
