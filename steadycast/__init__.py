"""Session quality forecasting and selective prediction on Spark."""

import sys

from pyspark import cloudpickle

# Code of this package that runs in Python workers travels with the job, so executors do
# not need the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
