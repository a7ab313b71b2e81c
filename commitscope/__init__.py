"""Commit-history analytics on Spark."""

import sys

from pyspark import cloudpickle

# Workers need no installed copy: functions sent to executors carry this package's code with them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
