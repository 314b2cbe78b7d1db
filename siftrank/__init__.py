"""Screening, ranking-evaluation and corpus operators written as Spark jobs."""

import sys

from pyspark import cloudpickle

# Executors need not have this package on their path: its functions travel with the tasks that use them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
