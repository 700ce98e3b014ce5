"""Statistical leakage evaluation on Spark DataFrames."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Executors need no installed copy: functions of this package travel with the job.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
