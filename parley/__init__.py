"""parley: conversation and feedback analytics on Spark DataFrames."""

import sys as _sys

__version__ = "0.1.0"

# Python code that runs inside Spark tasks (mapInPandas scans, the top-k
# kernel, stateful stream processors) is pickled by value, so executors do not
# need this package installed or on their path: only pyspark, numpy and pandas.
try:
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older pyspark without by-value support
    pass
