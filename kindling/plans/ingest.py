"""Ingest jobs: from files or texts to the chunk table."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindling import schemas
from kindling.cluster import broadcast_if_small, settle
from kindling.functions.charset import decode_text
from kindling.functions.embedder import Embedder
from kindling.functions.text import normalize_newlines
from kindling.operators import chunking, documents, embedding, quality, upsert
from kindling.sources import files as fl
from kindling.sources import large, store

Step = Callable[[DataFrame], DataFrame]


def apply_steps(rows: DataFrame, steps: Sequence[Step]) -> DataFrame:
    """Run the rows through transformations in order."""
    for step in steps:
        rows = rows.transform(step)
    return rows


def log_documents(
    files: DataFrame, fallback_charset: str = "utf-8", category: str = "log", author: str = "unknown"
) -> DataFrame:
    """Decoded files: ``doc_id, text, content_hash, file_size, metadata``."""
    text = normalize_newlines(decode_text(F.col("content"), fallback_charset))
    named = documents.with_metadata(files, F.col("file_name"), category, author)
    return named.select(F.col("file_path").alias("doc_id"), text.alias("text"), "content_hash", "file_size", "metadata")


def pending_chunks(
    files: DataFrame, ledger: DataFrame | None, steps: Sequence[Step], fallback_charset: str = "utf-8", author: str = "unknown"
) -> DataFrame:
    """Chunk rows of those files the ledger lacks; without a ledger, of all."""
    new = fl.content_hash(files)
    if ledger is not None:
        new = upsert.pending(new, ledger)
    return apply_steps(log_documents(new, fallback_charset, author=author), steps)


# How files too large for one row are cut: from rows ``file_path, file_size, charset`` to chunks.
CutLarge = Callable[[DataFrame], DataFrame]

# What becomes of the chunks: from session, store, rows and what the store holds.
Write = Callable[[SparkSession, str, DataFrame, store.Snapshot | None], int | str]


def publish_listed(
    files: DataFrame, listing: DataFrame, root: str, steps: Sequence[Step], embed_step: Step, cut_large: CutLarge,
    fallback_charset: str = "utf-8", author: str = "unknown", max_file_bytes: int = fl.MAX_FILE_BYTES,
    after: store.Snapshot | None = None, largest: int | None = None, write: Write = store.write_version,
) -> int | str:
    """Process those files the ledger lacks and publish them as a new version.

    ``files`` are those of at most ``max_file_bytes``, with contents; larger ones of ``listing``
    are read in pieces, with the same result. ``embed_step`` is what follows the cutting.
    ``after`` tells what the store holds, and ``largest`` a size that no file of ``listing`` exceeds, if that is known.
    Returns what ``write`` does, which is given the rows: the version.
    """
    spark = listing.sparkSession
    ledger = after.ledger if after else store.read_ledger(spark, root)
    rows = pending_chunks(files, ledger, [*steps, embed_step], fallback_charset, author)
    above = listing.filter(F.col("file_size") > max_file_bytes)
    if (largest is None or largest > max_file_bytes) and not above.isEmpty():
        names = schemas.STORED_CHUNKS.fieldNames()
        split = pending_large_chunks(above, ledger, cut_large, embed_step, fallback_charset, author)
        rows = rows.select(*names).unionByName(split.select(*names))
    return write(spark, root, rows, after)


def pending_large_chunks(
    listing: DataFrame, ledger: DataFrame | None, cut_large: CutLarge, embed_step: Step, fallback_charset: str, author: str
) -> DataFrame:
    """Chunk rows of those listed files the ledger lacks, for files too large for one row.

    One pass over each file tells its hash and encoding; the next ones read it in pieces.
    """
    new = chunking.inspected(listing, fallback_charset)
    new = settle(new if ledger is None else upsert.pending(new, ledger), "large")
    named = documents.with_metadata(new, F.col("file_name"), author=author)
    entries = named.select(F.col("file_path").alias("doc_id"), "content_hash", "file_size", "metadata")
    chunks = cut_large(new.select("file_path", "file_size", "charset"))
    return chunks.transform(embed_step).join(broadcast_if_small(entries), "doc_id")


def publish_fixed(files: DataFrame, listing: DataFrame, root: str, embedder: Embedder, **options) -> int | str:
    """Character windows and their vectors."""
    size, overlap = chunking.CHUNK_SIZE, chunking.CHUNK_OVERLAP
    return publish_listed(
        files, listing, root,
        [lambda docs: chunking.chunk_fixed(docs, size, overlap, keep_empty=True)],
        lambda chunks: embedding.embed(chunks, embedder),
        lambda told: large.window_rows(large.ranges(told), size, overlap, keep_empty=True),
        **options,
    )


def publish_sentences(files: DataFrame, listing: DataFrame, root: str, embedder: Embedder, cache_path: str | None, **options) -> int:
    """Sentence chunks and their vectors.

    The cache lookup reads the chunks several times, so they are written down first
    instead of reading and decoding the files for each pass.
    """

    def embed(chunks: DataFrame) -> DataFrame:
        if cache_path is None:
            return embedding.embed(chunks, embedder)
        return embedding.embed_cached(settle(chunks, "sentences"), embedder, cache_path)

    return publish_listed(
        files, listing, root,
        [lambda docs: chunking.chunk_sentences(docs, keep_empty=True)],
        embed,
        lambda told: large.sentence_rows(told, chunking.SENTENCE_CHUNK_WORDS, chunking.SENTENCE_OVERLAP_WORDS),
        **options,
    )


def ingest_logs(
    spark: SparkSession,
    logs_dir: str,
    root: str,
    embedder: Embedder,
    max_files_per_dir: int | None = None,
    fallback_charset: str = "utf-8",
    author: str = "unknown",
    max_file_bytes: int = fl.MAX_FILE_BYTES,
) -> DataFrame:
    """Ingest the ``.log`` files below ``logs_dir`` into the store at ``root``.

    Unchanged files are skipped, changed ones replaced. Returns the counts of the
    version written. ``max_files_per_dir=1`` takes one file per folder. Files above
    ``max_file_bytes`` are read in pieces, with the same result.
    """
    listing = fl.list_files(spark, logs_dir)
    if max_files_per_dir is not None:
        listing = fl.first_per_directory(listing, max_files_per_dir)
    files = fl.contents_of(spark, logs_dir, listing, max_bytes=max_file_bytes, picked=max_files_per_dir is not None)
    version = publish_fixed(
        files, listing, root, embedder, fallback_charset=fallback_charset, author=author, max_file_bytes=max_file_bytes
    )
    return version_counts(spark, root, version)


def ingest_directory(
    spark: SparkSession,
    directory: str,
    root: str,
    embedder: Embedder,
    cache_path: str | None = None,
    fallback_charset: str = "utf-8",
    max_file_bytes: int = fl.MAX_FILE_BYTES,
) -> DataFrame:
    """Ingest every file below ``directory`` in sentence chunks, reusing saved vectors.

    Unchanged files are skipped and changed ones replaced. Returns the counts of the
    version written.
    """
    listing = fl.list_files(spark, directory, glob=None)
    files = fl.contents_of(spark, directory, listing, glob=None, max_bytes=max_file_bytes)
    version = publish_sentences(
        files, listing, root, embedder, cache_path, fallback_charset=fallback_charset, max_file_bytes=max_file_bytes
    )
    return version_counts(spark, root, version)


def version_counts(spark: SparkSession, root: str, version: int) -> DataFrame:
    """Documents, chunks and failed embeddings of one version."""
    return quality.ingest_counts(store.read_stored(spark, root).filter(F.col("version") == version))


def add_texts(texts: DataFrame, path: str, embedder: Embedder) -> None:
    """Embed rows ``id, text`` and append them to the plain table at ``path``."""
    store.append_rows(embedding.embed(texts.select("id", "text"), embedder), path)
