"""nearframe: embedding and vector analytics as Spark DataFrame operations."""

import sys

from pyspark import cloudpickle

# Batch functions travel to the executors with the job itself, so a cluster
# needs no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
