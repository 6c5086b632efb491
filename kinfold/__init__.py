"""Genomic partitioning and prediction as PySpark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with the job: the package need not be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
