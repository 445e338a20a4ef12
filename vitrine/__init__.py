"""Catalogue ranking and PU-learning analytics as plain PySpark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Executors need no copy of this package: functions used in tasks travel with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
