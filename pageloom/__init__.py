"""A document index with exact vector search, as DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the job, so the package does
# not have to be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
