"""Registered queries and their SQL counterparts.

Every query reads whole tables of the given folder. ``queries()`` maps a name to a
function of (spark, folder); ``oracle_sql()`` holds the SQL that must give the same
rows. Real-valued results are rounded to 6 decimals for comparison only; nothing is
sorted or selected by a rounded value.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from kindling.cluster import new_folder, ship, spread
from kindling.functions import charset
from kindling.functions import text as tx
from kindling.functions import vectors as vx
from kindling.functions.embedder import Embedder, hashed_words
from kindling.operators import ann, chunking, documents, embedding, fields, knn, knn_join, phrase_index, quality, search, upsert
from kindling.operators import charset as charset_ops
from kindling.plans import ingest
from kindling.plans import search as search_plans
from kindling.sources import files as fl
from kindling.sources import store
from kindling.streaming.ingest import stream_ingest

try:  # the operators for training data are an optional part
    import corpus_pipeline
    from kindling.llm import queries as llm_queries
except ImportError as missing:
    if missing.name not in {"corpus_pipeline", "kindling.llm"}:
        raise
    llm_queries = None

EMBEDDER = hashed_words(64)

# Query texts. The first occurs in few chunks, so nearest vectors fill the rest of the
# k places; the second occurs in more chunks than k.
RARE_QUERY = "this work is licensed under the gnu general public license"
COMMON_QUERY = " LICENSE "
K = 10
CELLS = 16
STREAM_FILES = 400  # files of one micro-batch
LSH = ann.fit_lsh(64, bucket_length=0.5, tables=6)


# --- tables -----------------------------------------------------------------


def _table(spark: SparkSession, sf_dir: str, name: str, *keys: str) -> DataFrame:
    ship(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df, *keys) if keys else df


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents", "doc_id")


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_fixed(_documents(spark, sf_dir).select("doc_id", "text"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings")


_trees: dict[tuple[str, str], str] = {}


def log_tree(spark: SparkSession, sf_dir: str) -> str:
    """All documents as ``<source>/<doc_id>.log`` files in the shared folder, made once."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _trees:
        root = new_folder(spark, "logs")
        name = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".log"))
        fl.write_tree(_documents(spark, sf_dir).select(name.alias("rel_path"), F.encode("text", "UTF-8").alias("content")), root)
        _trees[key] = root
    return _trees[key]


def _rel(path: str = "file_path"):
    return F.regexp_extract(path, "([^/]+/[^/]+)$", 1)


def _rounded(column: str):
    return F.round(column, 6).alias(column)


def _hits(hits: DataFrame, *ids: str) -> DataFrame:
    return hits.select("query_id", "rank", *ids, _rounded("distance"))


# --- chunks and documents ---------------------------------------------------


def chunk_fixed(spark, sf_dir):
    return _chunks(spark, sf_dir)


def chunk_counts(spark, sf_dir):
    return chunking.chunk_counts(_documents(spark, sf_dir))


def chunks_per_document(spark, sf_dir):
    return quality.chunks_per_document(_chunks(spark, sf_dir))


def chunk_batches(spark, sf_dir):
    batches = chunking.number_batches(_chunks(spark, sf_dir), rows=32)
    return batches.groupBy("doc_id", "batch_idx").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(F.length("text")).alias("n_chars")
    )


def chunk_sentences(spark, sf_dir):
    return chunking.chunk_sentences(_documents(spark, sf_dir).select("doc_id", "text"))


def chunk_large_files(spark, sf_dir):
    chunks = chunking.chunk_large_files(spark, log_tree(spark, sf_dir))
    return chunks.select(_rel("doc_id").alias("rel_path"), "chunk_idx", "text")


def content_hash(spark, sf_dir):
    docs = _documents(spark, sf_dir).select("doc_id", F.encode("text", "UTF-8").alias("content"))
    return fl.content_hash(docs).select("doc_id", "content_hash", F.octet_length("content").cast("long").alias("file_size"))


def charset_decode(spark, sf_dir):
    """Each document in the encoding its language is given here, decoded again."""
    encoded = (
        F.when(F.col("lang") == "fr", F.concat(F.unhex(F.lit("FFFE")), F.encode("text", "UTF-16LE")))
        .when(F.col("lang") == "de", F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8")))
        .when(F.col("lang") == "es", F.concat(F.unhex(F.lit("FEFF")), F.encode("text", "UTF-16BE")))
        .otherwise(F.encode("text", "UTF-8"))
    )
    docs = _documents(spark, sf_dir).select("doc_id", encoded.alias("content"))
    return docs.select(
        "doc_id",
        charset.detect_charset(F.col("content")).alias("charset"),
        F.sha2(charset.decode_text(F.col("content")), 256).alias("text_hash"),
    )


def normalize_newlines(spark, sf_dir):
    """Line ends made mixed, then normalised."""
    mixed = F.replace(F.replace("text", F.lit(".\n"), F.lit(".\r\n")), F.lit(",\n"), F.lit(",\r"))
    docs = _documents(spark, sf_dir).select("doc_id", mixed.alias("text"))
    return docs.select("doc_id", F.sha2(tx.normalize_newlines(F.col("text")), 256).alias("text_hash"))


def render_document(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    named = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".log"))
    return documents.render(documents.with_metadata(docs, named, author="unknown")).select("doc_id", "rendered")


# --- phrase and hybrid search -----------------------------------------------


def phrase_matches(spark, sf_dir):
    return _chunks(spark, sf_dir).filter(tx.phrase_match(F.col("text"), RARE_QUERY)).select("doc_id", "chunk_idx")


def phrase_by_index(spark, sf_dir):
    """Documents that hold a whole benchmark text, or one of two phrases, found through a trigram index."""
    table, index = new_folder(spark, "texts"), new_folder(spark, "phrase-index")
    _documents(spark, sf_dir).select("doc_id", "text").repartitionByRange(16, "doc_id").write.parquet(table)
    phrase_index.build_phrase_index(spark, table, index)
    asked = _table(spark, sf_dir, "benchmark").select("item_id", "text")
    asked = asked.unionByName(spark.createDataFrame([(-1, RARE_QUERY), (-2, COMMON_QUERY)], "item_id long, text string"))
    return phrase_index.find_phrases(spark, table, index, asked, key="item_id", phrase_col="text").select("item_id", "doc_id")


def phrase_topk(spark, sf_dir):
    return search.phrase_topk(_chunks(spark, sf_dir), COMMON_QUERY, K)


def _hybrid(spark, sf_dir, query):
    hits = search.hybrid_search(embedding.embed(_chunks(spark, sf_dir), EMBEDDER), query, EMBEDDER.one(query), K)
    return hits.withColumn("distance", _rounded("distance"))


def hybrid_search(spark, sf_dir):
    return _hybrid(spark, sf_dir, RARE_QUERY)


def hybrid_search_many_phrases(spark, sf_dir):
    return _hybrid(spark, sf_dir, COMMON_QUERY)


def hybrid_by_union(spark, sf_dir):
    """The same search in separate steps: phrase hits, nearest vectors, union by key."""
    chunks = embedding.embed(_chunks(spark, sf_dir), EMBEDDER)
    exact = search.phrase_topk(chunks, RARE_QUERY, K).select("doc_id", "chunk_idx", F.lit(1.0).alias("score"))
    near = knn.knn(chunks, EMBEDDER.one(RARE_QUERY), K, ids=["doc_id", "chunk_idx"])
    near = near.select("doc_id", "chunk_idx", F.lit(0.5).alias("score"))
    return search.first_source_wins(exact, near, ["doc_id", "chunk_idx"])


def filtered_search(spark, sf_dir):
    """Hybrid search limited to documents of one language."""
    docs = _documents(spark, sf_dir).filter(F.col("lang") == "de").select("doc_id", "text")
    chunks = embedding.embed(chunking.chunk_fixed(docs), EMBEDDER)
    hits = search.hybrid_search(chunks, RARE_QUERY, EMBEDDER.one(RARE_QUERY), K)
    return hits.withColumn("distance", _rounded("distance"))


def hybrid_batch(spark, sf_dir):
    """Hybrid search for every benchmark text and for two phrases that occur, in one scan."""
    chunks = embedding.embed(_chunks(spark, sf_dir), EMBEDDER)
    asked = _table(spark, sf_dir, "benchmark").select("item_id", "text")
    phrases = spark.createDataFrame([(-1, RARE_QUERY), (-2, COMMON_QUERY)], "item_id long, text string")
    asked = embedding.embed(asked.unionByName(phrases), EMBEDDER)
    hits = search.hybrid_search_batch(chunks, asked.select(F.col("item_id").alias("query_id"), "text", F.lit(K).alias("k"), "embedding"))
    return hits.withColumn("distance", _rounded("distance"))


def prompt_context(spark, sf_dir):
    return documents.prompt_context(_hybrid(spark, sf_dir, RARE_QUERY))


def hit_lines(spark, sf_dir):
    return documents.hit_lines(_hybrid(spark, sf_dir, RARE_QUERY))


def search_store(spark, sf_dir):
    """Ingest the log tree, then search the stored chunks."""
    root = new_folder(spark, "store")
    ingest.ingest_logs(spark, log_tree(spark, sf_dir), root, EMBEDDER)
    hits = search_plans.search_logs(spark, root, RARE_QUERY, EMBEDDER, K)
    return hits.select(_rel("doc_id").alias("rel_path"), "chunk_idx", "score", _rounded("distance"))


def search_store_by_index(spark, sf_dir):
    """The same through an index: built, emptied with the store, then built again and searched in every cell."""
    root, tree = new_folder(spark, "store"), log_tree(spark, sf_dir)
    ingest.ingest_logs(spark, tree, root, EMBEDDER, max_files_per_dir=3)
    search_plans.build_index(spark, root, CELLS)
    store.truncate(spark, root)
    ingest.ingest_logs(spark, tree, root, EMBEDDER, max_files_per_dir=5)
    search_plans.build_index(spark, root, CELLS)
    ingest.ingest_logs(spark, tree, root, EMBEDDER)
    hits = search_plans.search_logs(spark, root, RARE_QUERY, EMBEDDER, K, probes=CELLS)
    return hits.select(_rel("doc_id").alias("rel_path"), "chunk_idx", "score", _rounded("distance"))


# --- vectors ----------------------------------------------------------------


def hash_embed(spark, sf_dir):
    docs = embedding.embed(_documents(spark, sf_dir).select("doc_id", "text"), EMBEDDER)
    weights = docs.select("doc_id", F.posexplode("embedding").alias("slot", "weight")).filter(F.col("weight") > 0)
    return weights.select("doc_id", "slot", F.round(F.col("weight").cast("double"), 6).alias("weight"))


def embed_cache(spark, sf_dir):
    """Vectors of labelled documents are saved; which texts remain, and what they get."""
    path = new_folder(spark, "vectors")
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").select("doc_id")
    labelled = docs.join(labels, "doc_id", "left_semi")
    empty = store.read_vectors(spark, path)
    store.save_vectors(embedding.cache_misses(labelled, empty, EMBEDDER), path)
    misses = embedding.cache_misses(docs, store.read_vectors(spark, path), EMBEDDER)
    return misses.select("text_hash", F.size(F.filter("embedding", lambda v: v > 0)).alias("n_slots"))


def embed_cached(spark, sf_dir):
    """Every document's vector through the cache, copies included."""
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    out = embedding.embed_cached(docs, EMBEDDER, new_folder(spark, "vectors"))
    return out.select("doc_id", F.size(F.filter("embedding", lambda v: v > 0)).alias("n_slots"))


def failed_embeddings(spark, sf_dir):
    """Counts with a model that fails on texts with a certain word."""

    def load():
        plain = EMBEDDER.load()

        def model(texts):
            if any("license" in t.lower() for t in texts):
                raise ValueError("this model cannot read licenses")
            return plain(texts)

        return model

    return quality.ingest_counts(embedding.embed(_chunks(spark, sf_dir), Embedder("fails-on-licenses", load)))


def masked_pool(spark, sf_dir):
    """Means of the vectors of each last digit, without those of even labels."""
    masked = _vectors(spark, sf_dir).select("embedding", (F.col("vec_id") % 10).alias("digit"), (F.col("label") % 2).alias("mask"))
    pooled = embedding.mean_pool(masked, ["digit"], mask="mask")
    return pooled.select("digit", F.posexplode("embedding").alias("slot", "value")).select("digit", "slot", _rounded("value"))


def mean_pool(spark, sf_dir):
    pooled = embedding.mean_pool(_vectors(spark, sf_dir), ["label"])
    return pooled.select("label", F.posexplode("embedding").alias("slot", "value")).select("label", "slot", _rounded("value"))


def dim_check(spark, sf_dir):
    return quality.dimension_range(_vectors(spark, sf_dir))


def unique_check(spark, sf_dir):
    texts = _documents(spark, sf_dir).select(F.sha2("text", 256).alias("text_hash"))
    return quality.duplicate_keys(texts, ["text_hash"])


def unique_chunks(spark, sf_dir):
    """Keys that occur twice after the chunks of toxic documents were added again."""
    toxic = _table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id")
    chunks = _chunks(spark, sf_dir)
    return quality.duplicate_keys(chunks.unionByName(chunks.join(toxic, "doc_id", "left_semi")), ["doc_id", "chunk_idx"])


def ingest_counts(spark, sf_dir):
    return quality.ingest_counts(embedding.embed(_chunks(spark, sf_dir), EMBEDDER))


def vector_shapes(spark, sf_dir):
    """Matrix form and back, 32-bit form, and a fixed dimension by padding or cutting."""
    v = vx.to_float32(vx.flatten_matrix(vx.as_matrix(F.col("embedding"))))
    shown = _vectors(spark, sf_dir).select("vec_id", v.alias("v"))
    return shown.select(
        "vec_id",
        F.size("v").alias("dim"),
        F.round(vx.norm(F.col("v")), 6).alias("norm"),
        F.size(vx.fit_dimension(F.col("v"), 80)).alias("padded_dim"),
        F.round(vx.norm(vx.fit_dimension(F.col("v"), 80)), 6).alias("padded_norm"),
        F.round(vx.norm(vx.fit_dimension(F.col("v"), 16)), 6).alias("cut_norm"),
    )


def _label_centres(vectors: DataFrame) -> DataFrame:
    return embedding.mean_pool(vectors, ["label"]).withColumnRenamed("label", "query_id")


def knn_l2(spark, sf_dir):
    return _hits(knn.knn(_vectors(spark, sf_dir), EMBEDDER.one(RARE_QUERY), K), "vec_id")


def knn_metrics(spark, sf_dir):
    hits = knn.knn_by_metrics(_vectors(spark, sf_dir), EMBEDDER.one(RARE_QUERY), K, sorted(vx.METRICS))
    return _hits(hits, "vec_id", "metric")


def cosine_topk(spark, sf_dir):
    hits = knn.cosine_topk(_vectors(spark, sf_dir), EMBEDDER.one(RARE_QUERY), K)
    return hits.select("query_id", "rank", "vec_id", _rounded("similarity"))


def knn_multi(spark, sf_dir):
    """The nearest vectors to the centre of every label."""
    vectors = _vectors(spark, sf_dir)
    return _hits(knn.knn_batch(vectors, _label_centres(vectors), K), "vec_id")


def knn_multi_blocked(spark, sf_dir):
    """The same, by the route taken when the queries are too many to send at once."""
    vectors = _vectors(spark, sf_dir)
    return _hits(knn.knn_batch(vectors, _label_centres(vectors), K, query_bytes=1500), "vec_id")


def knn_both_large(spark, sf_dir):
    """The nearest vectors to every vector, by the route that needs neither side to be small."""
    vectors = _vectors(spark, sf_dir)
    return _hits(knn_join.knn_join(vectors, vectors.withColumnRenamed("vec_id", "query_id"), K), "vec_id")


def semantic_batch(spark, sf_dir):
    """The nearest chunks to every benchmark passage."""
    chunks = embedding.embed(_chunks(spark, sf_dir), EMBEDDER).drop("text")
    asked = embedding.embed(_table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "query_id"), EMBEDDER)
    return _hits(knn.knn_batch(chunks, asked, 5, ids=["doc_id", "chunk_idx"]), "doc_id", "chunk_idx")


def fetch_records(spark, sf_dir):
    """The stored label of each nearest vector."""
    vectors = _vectors(spark, sf_dir)
    hits = knn.knn(vectors, EMBEDDER.one(RARE_QUERY), K).select("vec_id", "rank")
    return knn.fetch_records(hits, vectors.select("vec_id", "label"), ["vec_id"]).select("rank", "vec_id", "label")


def append_vectors(spark, sf_dir):
    """The vectors extended by the label centres, searched."""
    vectors = _vectors(spark, sf_dir).select("vec_id", "embedding")
    centres = embedding.mean_pool(_vectors(spark, sf_dir), ["label"])
    more = centres.select((-1 - F.col("label")).cast("long").alias("vec_id"), vx.to_float32(F.col("embedding")).alias("embedding"))
    return _hits(knn.knn(knn.append_vectors(vectors, more), EMBEDDER.one(RARE_QUERY), K), "vec_id")


# --- approximate search -----------------------------------------------------


def _ivf(spark, sf_dir, probes):
    """Cells around the label centres, so that SQL can tell which cells are probed."""
    vectors = _vectors(spark, sf_dir)
    centres = _label_centres(vectors)
    index = ann.Cells(np.array([r.embedding for r in centres.orderBy("query_id").collect()]))
    path = new_folder(spark, "cells")
    ann.write_cells(ann.assign_cells(vectors, index), path)
    return _hits(ann.ivf_search(spark.read.parquet(path), index, centres, K, probes), "vec_id")


def ann_ivf(spark, sf_dir):
    return _ivf(spark, sf_dir, 4)


def ann_ivf_exhaustive(spark, sf_dir):
    """Probing every cell of a k-means index is exact."""
    vectors = _vectors(spark, sf_dir)
    index = ann.train_cells(vectors, CELLS)
    path = new_folder(spark, "cells")
    ann.write_cells(ann.assign_cells(vectors, index), path)
    return _hits(ann.ivf_search(spark.read.parquet(path), index, _label_centres(vectors), K, CELLS), "vec_id")


def _buckets(spark, sf_dir) -> DataFrame:
    path = new_folder(spark, "buckets")
    ann.write_buckets(ann.bucket_rows(_vectors(spark, sf_dir), LSH), path)
    return spark.read.parquet(path)


def ann_lsh(spark, sf_dir):
    return _hits(ann.lsh_search(_buckets(spark, sf_dir), LSH, EMBEDDER.one(RARE_QUERY), K), "vec_id")


def ann_lsh_batch(spark, sf_dir):
    centres = _label_centres(_vectors(spark, sf_dir))
    return _hits(ann.lsh_search_batch(_buckets(spark, sf_dir), LSH, centres, K), "vec_id")


# --- ledger and upserts -----------------------------------------------------


def _document_files(spark, sf_dir) -> DataFrame:
    return _documents(spark, sf_dir).select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("file_path"),
        F.sha2("text", 256).alias("content_hash"),
        F.octet_length("text").cast("long").alias("file_size"),
        "doc_id",
    )


def _label_ledger(spark, sf_dir) -> DataFrame:
    """Labelled documents are known; those of quality 0 with another content."""
    known = _document_files(spark, sf_dir).join(_table(spark, sf_dir, "labels"), "doc_id")
    hashed = F.when(F.col("quality") == 0, F.reverse("content_hash")).otherwise(F.col("content_hash"))
    return known.select(
        "file_path",
        hashed.alias("content_hash"),
        "file_size",
        F.timestamp_seconds(F.lit(0)).alias("processed_at"),
        F.lit("processed").alias("status"),
    )


def incremental_files(spark, sf_dir):
    files = _document_files(spark, sf_dir).drop("doc_id")
    return upsert.pending(files, _label_ledger(spark, sf_dir))


def ledger_upsert(spark, sf_dir):
    ledger = _label_ledger(spark, sf_dir)
    entries = upsert.pending(_document_files(spark, sf_dir).drop("doc_id"), ledger)
    entries = entries.withColumn("processed_at", F.timestamp_seconds(F.lit(86400))).withColumn("status", F.lit("processed"))
    out = upsert.upsert_ledger(ledger, entries)
    return out.select("file_path", "content_hash", "file_size", F.unix_seconds("processed_at").alias("processed_sec"), "status")


def _upsert_parts(spark, sf_dir):
    """Documents labelled toxic change to their lower-case text."""
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    toxic = _table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id")
    changed = docs.join(toxic, "doc_id", "left_semi").select("doc_id", F.lower("text").alias("text"))
    return chunking.chunk_fixed(docs), toxic, chunking.chunk_fixed(changed)


def doc_upsert(spark, sf_dir):
    return upsert.replace_documents(*_upsert_parts(spark, sf_dir))


def doc_delete(spark, sf_dir):
    chunks, toxic, _ = _upsert_parts(spark, sf_dir)
    return upsert.replace_documents(chunks, toxic, chunks.limit(0)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"))


# --- files and stores -------------------------------------------------------


def scan_logs(spark, sf_dir):
    files = fl.content_hash(fl.scan_files(spark, log_tree(spark, sf_dir)))
    docs = ingest.log_documents(files)
    return docs.select(
        _rel("doc_id").alias("rel_path"), F.length("text").alias("n_chars"), "content_hash", "file_size",
        F.element_at("metadata", "file_name").alias("file_name"),
    )


def first_per_directory(spark, sf_dir):
    files = fl.scan_files(spark, log_tree(spark, sf_dir), max_files_per_dir=1)
    return fl.content_hash(files).select(_rel().alias("rel_path"), "content_hash")


def visit_files(spark, sf_dir):
    """Hash every file by a callback that streams it."""
    seen = fl.visit_files(fl.list_files(spark, log_tree(spark, sf_dir)), fl.streamed_sha256)
    return seen.select(_rel().alias("rel_path"), F.col("result").alias("content_hash"))


def ingest_logs(spark, sf_dir):
    """Ingest the log tree twice; the second run finds nothing new."""
    root, tree = new_folder(spark, "store"), log_tree(spark, sf_dir)
    ingest.ingest_logs(spark, tree, root, EMBEDDER)
    ingest.ingest_logs(spark, tree, root, EMBEDDER)
    return store.read_chunks(spark, root).select(_rel("doc_id").alias("rel_path"), "chunk_idx", "text")


def mixed_tree(spark: SparkSession, sf_dir: str) -> str:
    """The log tree in several encodings by language, with other line ends for one source."""
    root = new_folder(spark, "mixed")
    text = F.when(F.col("source") == "src1", F.replace("text", F.lit("\n"), F.lit("\r"))).otherwise(F.replace("text", F.lit("\n"), F.lit("\r\n")))
    content = (
        F.when(F.col("lang") == "fr", F.concat(F.unhex(F.lit("FFFE")), F.encode(text, "UTF-16LE")))
        .when(F.col("lang") == "es", F.concat(F.unhex(F.lit("EFBBBF")), F.encode(text, "UTF-8")))
        .when(F.col("lang") == "de", F.encode(text, "ISO-8859-1"))
        .otherwise(F.encode(text, "UTF-8"))
    )
    name = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".log"))
    fl.write_tree(_documents(spark, sf_dir).select(name.alias("rel_path"), content.alias("content")), root)
    return root


def _ingest_mixed(spark, sf_dir, max_file_bytes):
    root = new_folder(spark, "store")
    tree = mixed_tree(spark, sf_dir)
    ingest.ingest_logs(spark, tree, root, EMBEDDER, fallback_charset="latin-1", max_file_bytes=max_file_bytes)
    return store.read_chunks(spark, root).select(_rel("doc_id").alias("rel_path"), "chunk_idx", "text")


GUESSED = ["utf-8", "utf-16-le", "utf-16-be", "cp1252", "cp850", "mac_roman"]


def charset_guess(spark, sf_dir):
    """How often the encoding of documents beyond ASCII is told right, for each of six, from pieces of 1,000 bytes."""
    given = F.get(F.array(*map(F.lit, GUESSED)), F.pmod("doc_id", F.lit(len(GUESSED))).cast("int"))
    docs = _documents(spark, sf_dir).filter(F.length("text") >= 200).filter(F.col("text").rlike("[^\\x00-\\x7f]"))
    docs = docs.select("doc_id", "text", given.alias("encoding"))
    files = docs.select("doc_id", charset_ops.encode_text(F.col("text"), F.col("encoding")).alias("content"))
    found = charset_ops.guess_charsets(charset_ops.cut_pieces(files, "doc_id", "content", 1000), "doc_id")
    told = docs.select("doc_id", "encoding").join(found, "doc_id")
    return told.groupBy("encoding").agg(
        F.count(F.lit(1)).alias("n_files"),
        F.sum(F.when(F.col("encoding").startswith("utf"), F.col("n_bytes"))).alias("n_bytes"),
        (F.avg((F.col("charset") == F.col("encoding")).cast("int")) >= 0.95).alias("mostly_right"),
    )


def ingest_mixed_encodings(spark, sf_dir):
    """Files in several encodings, each read as one row."""
    return _ingest_mixed(spark, sf_dir, fl.MAX_FILE_BYTES)


def ingest_mixed_encodings_split(spark, sf_dir):
    """The same files, all taken as too large for one row."""
    return _ingest_mixed(spark, sf_dir, 1)


def truncate_store(spark, sf_dir):
    """Ingest the log tree, empty the store, and ingest one file of each folder."""
    root, tree = new_folder(spark, "store"), log_tree(spark, sf_dir)
    ingest.ingest_logs(spark, tree, root, EMBEDDER)
    store.truncate(spark, root)
    ingest.ingest_logs(spark, tree, root, EMBEDDER, max_files_per_dir=1)
    return store.read_chunks(spark, root).select(_rel("doc_id").alias("rel_path"), "chunk_idx", "text")


def ingest_ledger(spark, sf_dir):
    root = new_folder(spark, "store")
    ingest.ingest_logs(spark, log_tree(spark, sf_dir), root, EMBEDDER)
    return store.read_ledger(spark, root).select(_rel().alias("rel_path"), "content_hash", "file_size", "status")


def ingest_directory(spark, sf_dir):
    """Ingest every file in sentence chunks through the vector cache."""
    root = new_folder(spark, "store")
    ingest.ingest_directory(spark, log_tree(spark, sf_dir), root, EMBEDDER, new_folder(spark, "vectors"))
    return store.read_chunks(spark, root).select(_rel("doc_id").alias("rel_path"), "chunk_idx", "text")


def add_texts(spark, sf_dir):
    """Append all conversation turns with their vectors, then search them by cosine."""
    path = new_folder(spark, "texts")
    turns = _table(spark, sf_dir, "conversations")
    ident = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    ingest.add_texts(turns.select(ident.alias("id"), "text"), path, EMBEDDER)
    hits = search_plans.similar_texts(spark, path, "the and of the", EMBEDDER, K)
    return hits.select("rank", "id", "text", _rounded("similarity"))


def stream_ingest_logs(spark, sf_dir):
    """Ingest the log tree as a stream of what is there now, in several micro-batches of larger tables."""
    root = new_folder(spark, "store")
    query = stream_ingest(spark, log_tree(spark, sf_dir), root, EMBEDDER, new_folder(spark, "stream"), STREAM_FILES)
    query.awaitTermination()
    return store.read_chunks(spark, root).select(_rel("doc_id").alias("rel_path"), "chunk_idx", "text")


# --- fields -----------------------------------------------------------------


def event_fields(spark, sf_dir):
    return fields.json_fields(_table(spark, sf_dir, "events"), "props", {"k": "int"}).select("event_id", "k")


def events_by_time_and_level(spark, sf_dir):
    """Each event as a log line, its time and level read back and counted by hour."""
    line = F.concat_ws(" ", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.upper("event_type"), "props")
    lines = _table(spark, sf_dir, "events").select(line.alias("text"))
    counts = fields.count_by_time_and_level(lines, ["ERROR", "VIEW", "CLICK", "SIGNUP", "PURCHASE"])
    return counts.select(F.date_format("hour", "yyyy-MM-dd HH:mm:ss").alias("hour"), "level", "n_lines")


def key_value_fields(spark, sf_dir):
    """Pairs of a line made from each document; the later of two equal keys counts."""
    docs = _documents(spark, sf_dir)
    line = F.concat_ws(" ", F.lit("id=0"), F.concat(F.lit("lang="), "lang"), F.lit("noise"), F.concat(F.lit("chars="), "n_chars"), F.concat(F.lit("id="), "doc_id"))
    read = fields.key_value_fields(docs.select("doc_id", line.alias("text")))
    return read.select("doc_id", *[F.try_element_at("fields", F.lit(k)).alias(f"{k}_value") for k in ("id", "lang", "chars")])


def vm_lines(spark, sf_dir):
    """Lines that name a machine of a list; ids are formed from hashes of document ids."""
    digest = F.md5(F.col("doc_id").cast("string"))
    parts = [F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    vm = F.concat_ws("-", *parts)
    lines = _documents(spark, sf_dir).select("doc_id", F.concat(F.lit("vm "), vm, F.lit(" said "), F.lit("hello")).alias("text"))
    toxic = _table(spark, sf_dir, "labels").filter("toxic = 1").select(vm.alias("vm_id"))
    return fields.lines_of_vms(lines, toxic).select("doc_id", "vm_id")


def regex_literal(spark, sf_dir):
    """Chunks that hold a phrase full of pattern characters."""
    found = _chunks(spark, sf_dir).filter(F.rlike("text", F.lit(tx.regex_literal(".*** "))))
    return found.select("doc_id", "chunk_idx")


# --- registry ---------------------------------------------------------------

_QUERIES = [
    chunk_fixed, chunk_counts, chunks_per_document, chunk_batches, chunk_sentences, chunk_large_files,
    content_hash, charset_decode, normalize_newlines, render_document,
    phrase_matches, phrase_by_index, phrase_topk, hybrid_search, hybrid_search_many_phrases, hybrid_by_union, filtered_search,
    prompt_context, hit_lines, search_store, search_store_by_index,
    hash_embed, embed_cache, embed_cached, mean_pool, dim_check, unique_check, unique_chunks, ingest_counts,
    vector_shapes, knn_l2, knn_metrics, cosine_topk, knn_multi, knn_multi_blocked, knn_both_large, semantic_batch, fetch_records,
    append_vectors, ann_ivf, ann_ivf_exhaustive, ann_lsh, ann_lsh_batch,
    incremental_files, ledger_upsert, doc_upsert, doc_delete,
    scan_logs, first_per_directory, visit_files, ingest_logs, ingest_ledger, ingest_directory, add_texts,
    charset_guess, ingest_mixed_encodings, ingest_mixed_encodings_split, truncate_store, failed_embeddings, masked_pool,
    key_value_fields, vm_lines, regex_literal, hybrid_batch,
    stream_ingest_logs, event_fields, events_by_time_and_level,
]


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: hybrid search over the chunks of all documents."""
    return hybrid_search(spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {q.__name__: q for q in _QUERIES}
    if llm_queries:
        found |= llm_queries.queries() | {"pipeline": corpus_pipeline.run}
    return found


def oracle_sql() -> dict[str, str]:
    import oracle_statements

    found = oracle_statements.statements(EMBEDDER, RARE_QUERY, COMMON_QUERY, K, LSH)
    if llm_queries:
        found |= llm_queries.oracle_sql()
    return found
