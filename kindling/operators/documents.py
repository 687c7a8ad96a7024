"""Attach metadata to documents, render them, and project hits."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Default layout of a rendered document.
METADATA_TEMPLATE = "{key}=>{value}"
METADATA_SEPARATOR = "::"
TEXT_TEMPLATE = "Metadata: {metadata_str}\n-----\nContent: {content}"


def with_metadata(docs: DataFrame, file_name: Column, category: str = "log", author: str = "unknown") -> DataFrame:
    """Add the ``metadata`` map: file name, category and author."""
    entries = [F.lit("file_name"), file_name, F.lit("category"), F.lit(category), F.lit("author"), F.lit(author)]
    return docs.withColumn("metadata", F.create_map(*entries))


def _fill(template: str, **slots: Column) -> Column:
    """The template with each ``{name}`` replaced by a column, as one concat."""
    parts: list[Column] = []
    rest = template
    while rest:
        spots = {rest.find("{" + name + "}"): name for name in slots if "{" + name + "}" in rest}
        if not spots:
            parts.append(F.lit(rest))
            break
        at = min(spots)
        if at:
            parts.append(F.lit(rest[:at]))
        parts.append(slots[spots[at]])
        rest = rest[at + len(spots[at]) + 2 :]
    return F.concat(*parts) if parts else F.lit("")


def render(
    docs: DataFrame,
    excluded_keys: Iterable[str] = ("file_name",),
    metadata_template: str = METADATA_TEMPLATE,
    separator: str = METADATA_SEPARATOR,
    text_template: str = TEXT_TEMPLATE,
) -> DataFrame:
    """Add ``rendered``: metadata pairs without the excluded keys, then the text."""
    hidden = list(excluded_keys)
    shown = F.map_filter("metadata", lambda k, _: ~k.isin(hidden)) if hidden else F.col("metadata")
    pairs = F.transform(F.map_entries(shown), lambda e: _fill(metadata_template, key=e["key"], value=e["value"]))
    return docs.withColumn("rendered", _fill(text_template, metadata_str=F.array_join(pairs, separator), content=F.col("text")))


def hit_lines(hits: DataFrame) -> DataFrame:
    """One ``doc_id: text`` line per hit, in rank order within its query."""
    line = F.concat_ws(": ", F.col("doc_id").cast("string"), "text")
    return hits.select("query_id", "rank", line.alias("line"))


def prompt_context(hits: DataFrame, separator: str = "\n\n") -> DataFrame:
    """The texts of each query's hits joined in rank order, one row per query.

    A query has at most k hits, so its group is bounded.
    """
    ranked = F.array_sort(F.collect_list(F.struct("rank", "text")))
    return hits.groupBy("query_id").agg(F.array_join(F.transform(ranked, lambda h: h["text"]), separator).alias("context"))
