"""Delivery-loss and fraud analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions of this package used in tasks travel with the task, so that executors
# do not need the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
