"""Symbol and term analytics on Spark: match symbol catalogues against text corpora."""

import sys

from pyspark import cloudpickle

# The few Python functions that run in tasks travel with the task, so executors
# need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
