"""Search jobs over a stored chunk table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindling.functions.embedder import Embedder
from kindling.functions.text import phrase_match
from kindling.operators import ann, knn, search
from kindling.sources import store


def build_index(spark: SparkSession, root: str, cells: int = ann.CELLS) -> int:
    """Write an approximate index of the store's live vectors; returns the version it covers.

    The vectors are stored by cell beside the store. Later versions need no rebuild: what
    they add is searched in full and what they replace is left out.
    """
    version = store.last_version(spark, root)
    rows = store.read_stored(spark, root).filter(F.col("embedding").isNotNull()).select("doc_id", "chunk_idx", "version", "text", "embedding")
    index = ann.train_cells(rows, cells)
    path = f"{root}/index/{version}"
    ann.write_cells(ann.assign_cells(rows, index), f"{path}/cells", mode="overwrite")
    ann.save_centroids(spark, index, f"{path}/centroids")
    spark.createDataFrame([(version,)], "indexed int").coalesce(1).write.mode("append").parquet(f"{root}/index/versions")
    return version


def _search_index(spark: SparkSession, root: str, version: int, query: str, embedder: Embedder, top_k: int, probes: int) -> DataFrame:
    """One scan of the texts for the phrase; vectors are read for the probed cells, later versions and the hits only."""
    index = ann.load_centroids(spark, f"{root}/index/{version}/centroids")
    vector = embedder.one(query)
    columns = ["doc_id", "chunk_idx", "version", "text", "embedding"]
    live = store.read_stored(spark, root).filter(F.col("chunk_idx").isNotNull())
    found = live.filter(phrase_match(F.col("text"), query)).select("doc_id", "chunk_idx", "version").orderBy("doc_id", "chunk_idx").limit(top_k)
    # At most k keys; their versions and documents prune the lookup.
    keys = [tuple(r) for r in found.collect()]
    exact = live.filter(F.col("version").isin(sorted({v for _, _, v in keys})) & F.col("doc_id").isin(sorted({d for d, _, _ in keys})))
    exact = exact.filter(F.struct("doc_id", "chunk_idx").isin([F.struct(F.lit(d), F.lit(c).cast("int")) for d, c, _ in keys])) if keys else live.limit(0)
    probed = index.nearest(np.array([vector if vector is not None else np.zeros(index.centroids.shape[1])]), probes)[0].tolist()
    stored = spark.read.parquet(f"{root}/index/{version}/cells").filter(F.col("cell").isin(probed)).select(*columns)
    late = live.filter(F.col("version") > version).select(*columns)
    candidates = store.without_stale(spark, root, stored.unionByName(late))
    known = spark.createDataFrame([(d, c) for d, c, _ in keys], "doc_id string, chunk_idx int")
    others = candidates.join(F.broadcast(known), ["doc_id", "chunk_idx"], "left_anti")
    rows = exact.select(*columns).unionByName(others.select(*columns)).drop("version")
    return search.hybrid_search(rows, query, vector, top_k)


def search_logs(
    spark: SparkSession,
    root: str,
    query: str,
    embedder: Embedder,
    top_k: int = 5,
    where: Column | None = None,
    probes: int | None = None,
) -> DataFrame:
    """Hybrid search of a store: ``query_id, rank, doc_id, chunk_idx, text, score, distance``.

    ``where`` limits the search to chunks that satisfy a condition on the stored
    columns, such as ``F.col("metadata")["category"] == "log"``. With ``probes``, the nearest
    vectors come from that many cells of the index that ``build_index`` wrote; a store without
    an index is searched in full.
    """
    if probes is not None:
        if where is not None:
            raise ValueError("a condition needs the full search")
        version = store.indexed_version(spark, root)
        if version is not None:
            return _search_index(spark, root, version, query, embedder, top_k, probes)
    chunks = store.read_chunks(spark, root)
    if where is not None:
        chunks = chunks.filter(where)
    return search.hybrid_search(chunks, query, embedder.one(query), top_k)


def similar_texts(spark: SparkSession, path: str, query: str, embedder: Embedder, k: int) -> DataFrame:
    """Cosine search of the plain table that ``add_texts`` fills: ``rank, id, text, similarity``."""
    rows = store.read_rows(spark, path)
    vector = embedder.one(query)
    if vector is None:
        return rows.limit(0).select(F.lit(0).alias("rank"), "id", "text", F.lit(0.0).alias("similarity"))
    hits = knn.cosine_topk(rows, vector, k, ids=["id", "text"])
    return hits.select("rank", "id", "text", "similarity")
