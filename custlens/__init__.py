"""custlens: customer and marketing analytics operators on Spark DataFrames.

Every operator takes a DataFrame plus column names and options and returns a
DataFrame (models additionally return a small frozen result object).  Row-level
work runs on Spark; only bounded aggregates (one row per group, p x p matrices,
k x d centroids) are finished on the driver.
"""

from custlens.session import checkpoint_dir, get_spark

__all__ = ["get_spark", "checkpoint_dir"]

# Functions of this package travel to the executors by value, so Python workers
# need not be able to import it.
import sys as _sys  # noqa: E402

from pyspark import cloudpickle as _cloudpickle  # noqa: E402

_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
