"""Documents to training ids, in stages that are written down and read again.

Each stage takes the documents its predecessor kept, and all but the last return the columns
of documents. Null ids pass every stage that looks rows up by id.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindling.cluster import broadcast_if_small, settle, ship, spread
from kindling.llm import byte_bpe, line_windows, shingle_tree, string_tiling, toxicity
from kindling.llm.queries import BYTE_BPE

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents whose id is not listed; the list is sent to the tasks only if it is small."""
    listed = broadcast_if_small(settle(ids.select(F.col("doc_id").alias("gone")).distinct(), "gone"))
    return docs.join(listed, F.col("doc_id") == F.col("gone"), "left_anti").select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below one half by a model of the labels that are not held out."""
    ship(spark)
    model = toxicity.train(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model, output="__score").filter("__score < 0.5").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the later occurrences of three-line windows; documents of which nothing is left go."""
    ship(spark)
    out = line_windows.line_dedup(docs)
    out = out.filter((F.col("n_removed") == 0) | F.col("text").rlike(r"\S"))
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n_chars).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of every component of similar texts."""
    ship(spark)
    found = shingle_tree.similar_texts(docs.select("doc_id", "text"))
    return _without(docs, found.filter("doc_id != component_id"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover no benchmark item."""
    ship(spark)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _without(docs, string_tiling.find_leaks(docs.select("doc_id", "text"), items))


def encode_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's ids as little-endian unsigned 32-bit integers, in place of its text."""
    ship(spark)
    # Replaced, so that the text is not sent back from Python.
    out = byte_bpe.tokenize(docs, BYTE_BPE, public_tokenizers.PATTERN, output="text")
    out = out.select(*(c for c in docs.columns if c != "text"), F.col("text").alias("ids"))
    return out.withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("shingle_join", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("byte_bpe", encode_documents),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


# Learned scores, the tiling and the merges are beyond SQL; tests hold the stages to plain Python.
ORACLE_SQL = None
