"""Embed texts, reuse saved vectors, and pool token vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindling.functions.embedder import Embedder
from kindling.operators.joins import anti_join, lookup
from kindling.sources import store


def embed(rows: DataFrame, embedder: Embedder, text: str = "text", vector: str = "embedding") -> DataFrame:
    """Add the vector of each text; null where the model failed. No shuffle."""
    return rows.withColumn(vector, embedder.column(F.col(text)))


def text_hash(text: str = "text"):
    return F.sha2(F.col(text), 256)


def cache_misses(rows: DataFrame, cache: DataFrame, embedder: Embedder) -> DataFrame:
    """Vectors of the distinct texts the cache lacks: ``model, text_hash, embedding``.

    Saved texts are left out before anything is shuffled, and copies collapse in each
    task. Failed texts are left out, so they are tried again.
    """
    texts = rows.filter(F.col("text").isNotNull()).select("text", text_hash().alias("text_hash"))
    known = cache.filter(F.col("model") == embedder.name)
    # Only texts the cache lacks are shuffled.
    missing = anti_join(texts, known, ["text_hash"]).dropDuplicates(["text_hash"])
    made = embed(missing, embedder).filter(F.col("embedding").isNotNull())
    return made.select(F.lit(embedder.name).alias("model"), "text_hash", "embedding")


def embed_cached(rows: DataFrame, embedder: Embedder, cache_path: str) -> DataFrame:
    """Like ``embed``, with vectors kept in a table keyed by model and text hash.

    Only texts never seen before reach the model; their vectors are saved first and
    then looked up, so a rerun after a failure continues from what was saved.
    """
    spark = rows.sparkSession
    store.save_vectors(cache_misses(rows, store.read_vectors(spark, cache_path), embedder), cache_path)
    saved = store.read_vectors(spark, cache_path).filter(F.col("model") == embedder.name)
    vectors = saved.select("text_hash", "embedding").dropDuplicates(["text_hash"])
    return lookup(rows.withColumn("text_hash", text_hash()), vectors, "text_hash").drop("text_hash")


def mean_pool(
    tokens: DataFrame, keys: Sequence[str], vector: str = "embedding", mask: str | None = None
) -> DataFrame:
    """Mean of the vectors of each group: ``<keys>, embedding`` in double.

    ``mask`` names a 0/1 column; masked-out rows do not count. The mean is built up
    in each task before the shuffle, so a large group costs no more than a small one.
    """
    usable = tokens.filter(F.col(vector).isNotNull())
    if mask is not None:
        usable = usable.filter(F.col(mask) != 0)
    mean = Summarizer.mean(array_to_vector(F.col(vector).cast("array<double>")))
    return usable.groupBy(*keys).agg(vector_to_array(mean).alias("embedding"))
