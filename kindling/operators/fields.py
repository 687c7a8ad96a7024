"""Structured fields in log text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindling.functions.text import evaluate_once
from kindling.operators.joins import semi_join

# Usual level names, an ISO-like time, and the shape of a VM id.
LEVELS = ["TRACE", "DEBUG", "INFO", "WARNING", "WARN", "ERROR", "CRITICAL", "FATAL"]
TIME_PATTERN = "(\\d{4}-\\d{2}-\\d{2}[ T]\\d{2}:\\d{2}:\\d{2})"
VM_ID_PATTERN = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"


def json_fields(rows: DataFrame, column: str, fields: dict[str, str]) -> DataFrame:
    """Add one column per JSON field with the given type; null where absent or malformed."""
    schema = ", ".join(f"`{name}` {kind}" for name, kind in fields.items())
    parsed = rows.withColumn("_parsed", F.from_json(column, schema))
    return parsed.select(*rows.columns, *[F.col("_parsed")[name].alias(name) for name in fields])


def key_value_fields(rows: DataFrame, column: str = "text") -> DataFrame:
    """Add ``fields``: the ``key=value`` pairs of each line as a map; a later pair wins."""
    pairs = F.regexp_extract_all(column, F.lit("(\\w+=[^\\s,;]+)"), F.lit(1))
    entries = F.transform(pairs, lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.regexp_replace(p, "^\\w+=", "").alias("v")))

    def last_wins(backwards: Column) -> Column:
        def first_places(keys: Column) -> Column:
            return F.reverse(F.filter(backwards, lambda e, i: F.array_position(keys, e["k"]) == i + 1))

        return evaluate_once(F.transform(backwards, lambda e: e["k"]), first_places)

    return rows.withColumn("fields", F.map_from_entries(evaluate_once(F.reverse(entries), last_wins)))


def time_and_level(lines: DataFrame, levels: Sequence[str] = LEVELS, column: str = "text") -> DataFrame:
    """Add ``logged_at`` and ``level``, read from the line; null where it has none."""
    stamp = F.translate(F.regexp_extract(column, TIME_PATTERN, 1), "T", " ")
    level = F.regexp_extract(column, f"\\b({'|'.join(levels)})\\b", 1)
    return lines.withColumns(
        {
            "logged_at": F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd HH:mm:ss")),
            "level": F.when(level != "", level),
        }
    )


def count_by_time_and_level(lines: DataFrame, levels: Sequence[str] = LEVELS, column: str = "text") -> DataFrame:
    """Lines per hour and level."""
    read = time_and_level(lines, levels, column)
    return read.groupBy(F.date_trunc("hour", "logged_at").alias("hour"), "level").agg(F.count(F.lit(1)).alias("n_lines"))


def lines_of_vms(lines: DataFrame, vm_ids: DataFrame, column: str = "text") -> DataFrame:
    """One row per line and listed VM id it mentions: the line's columns and ``vm_id``."""
    mentioned = F.array_distinct(F.regexp_extract_all(column, F.lit(f"({VM_ID_PATTERN})"), F.lit(1)))
    return semi_join(lines.withColumn("vm_id", F.explode(mentioned)), vm_ids, ["vm_id"])
