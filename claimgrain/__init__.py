"""claimgrain: evidence-graded retrieval analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

from claimgrain.session import build_session

# Python workers get the package's functions with the task, so nothing has to be installed
# on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session"]
