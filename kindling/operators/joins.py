"""Join helpers that hold up when one key carries a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindling.cluster import BROADCAST_BYTES, broadcast_if_small, byte_size, is_plain_scan, settle

# A key is hot when it holds more than one row in this many; there are at most as
# many hot keys, so a table of them is always small.
HOT_SHARE = 1000


def anti_join(rows: DataFrame, keys_of: DataFrame, keys: Sequence[str], max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Rows whose key is absent from ``keys_of``. Keys are broadcast if measured small."""
    return rows.join(broadcast_if_small(keys_of.select(*keys).distinct(), max_bytes), list(keys), "left_anti")


def semi_join(rows: DataFrame, keys_of: DataFrame, keys: Sequence[str], max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Rows whose key is present in ``keys_of``. Keys are broadcast if measured small."""
    return rows.join(broadcast_if_small(keys_of.select(*keys).distinct(), max_bytes), list(keys), "left_semi")


def lookup(rows: DataFrame, table: DataFrame, key: str, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Left join to a table that holds each key once.

    A small table is broadcast. Otherwise the rows of hot keys stay where they are
    and receive the few matching table rows by broadcast, and only the others are
    shuffled, so no task gets a hot key's rows.
    """
    if not is_plain_scan(table):
        table = settle(table, "table")
    if byte_size(table) <= max_bytes:
        return rows.join(F.broadcast(table), key, "left")
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = rows.count()
    hot = [r[0] for r in counts.filter((F.col("n") * HOT_SHARE > total) & F.col(key).isNotNull()).select(key).collect()]
    if not hot:
        return rows.join(table, key, "left")
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    heavy = rows.filter(is_hot).join(F.broadcast(table.filter(is_hot)), key, "left")
    return heavy.unionByName(rows.filter(~is_hot).join(table.filter(~is_hot), key, "left"))
