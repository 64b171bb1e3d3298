"""tablewright: tabular preparation, profiling and model comparison as Spark jobs.

Every operator takes and returns Spark DataFrames; statistics are computed by
distributed aggregations and only small, size-bounded results (one row per
column, per class or per bin) are brought back to the driver.
"""

from tablewright.session import get_spark, checkpoint_dir  # noqa: F401

__all__ = ["get_spark", "checkpoint_dir"]
