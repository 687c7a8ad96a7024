"""How large a table is, for the number of buckets it is dealt into."""

from __future__ import annotations

from pyspark.sql import DataFrame

from kindling.cluster import byte_size, scan_bytes

# What Spark cannot estimate has a size of about 2 to the power of 63.
_UNKNOWN = 1 << 50


def table_bytes(df: DataFrame) -> int:
    """The plan's estimate, which files have; else a sum over the rows."""
    estimate = scan_bytes(df)
    return estimate if estimate < _UNKNOWN else byte_size(df)
