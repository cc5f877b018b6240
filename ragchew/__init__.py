"""ragchew: contest-log and beacon-spot analytics as Spark DataFrame jobs.

Every public function takes and returns a ``pyspark.sql.DataFrame``; nothing is
collected to the driver except the size checks that guard broadcasts.
"""

from ragchew.session import get_spark, checkpoint_dir  # noqa: F401

__all__ = ["get_spark", "checkpoint_dir"]
