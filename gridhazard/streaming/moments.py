"""Running mean and deviation over realization files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_moment_stream(stream: DataFrame, keys, value) -> DataFrame:
    """Count, mean and population deviation per key; the state holds one row per key."""
    x = F.col(value)
    return stream.groupBy(*keys).agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std")
    )
