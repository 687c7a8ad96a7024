"""Incremental ingestion of a log folder as a stream."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kindling.functions.embedder import Embedder
from kindling.plans import ingest
from kindling.sources import files as fl
from kindling.sources import store

_LOOKUP_TASKS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def stream_ingest(
    spark: SparkSession,
    logs_dir: str,
    root: str,
    embedder: Embedder,
    checkpoint: str,
    max_files_per_trigger: int = 1000,
    available_now: bool = True,
    fallback_charset: str = "utf-8",
    max_file_bytes: int = fl.MAX_FILE_BYTES,
) -> StreamingQuery:
    """Feed new ``.log`` files below ``logs_dir`` into the store at ``root``.

    Each micro-batch is published as one version through the same ledger check as the
    batch job, so a batch repeated after a failure changes nothing. The stream sees
    each path once; rewritten files are picked up by the batch job.

    With ``available_now`` the tree is listed once and the stream is one of its listing, kept at ``checkpoint``:
    Spark's own source looks through all files again for every micro-batch. As the paths of later micro-batches
    are known, their chunks are prepared while earlier ones are published, one after the other. Spark's source is
    used for trees that only Spark can list, for checkpoints it began, and for a stream without end; should
    that go on from a listed checkpoint, files seen before are told by the ledger.

    A micro-batch costs about the same however many came before: as no two hold the same
    path, they are checked against what the store held when the stream began, or when another
    writer last changed it. The query runs in a copy of the session.
    """
    versions = store.Writer(root)
    options = {"fallback_charset": fallback_charset, "max_file_bytes": max_file_bytes}
    # Each trigger of Spark's source looks its files up by path, one path a task unless fewer tasks are asked for. The
    # source takes that setting from the session it was made in, so this one is a copy.
    own = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    own.conf.set(_LOOKUP_TASKS, str(min(int(spark.conf.get(_LOOKUP_TASKS)), spark.sparkContext.defaultParallelism)))

    def publish(batch: DataFrame, _batch_id: int) -> None:
        # A split holds few files, as each counts as at least 4 MB.
        listing = batch.coalesce(spark.sparkContext.defaultParallelism)
        small = fl.read_contents(listing.filter(F.col("file_size") <= max_file_bytes))
        held = versions.snapshot(batch.sparkSession)
        versions.wrote(ingest.publish_fixed(small, listing, root, embedder, after=held, **options))

    if available_now and fl.can_stream_listing(spark, logs_dir, checkpoint):
        listed = fl.stream_listing(own, logs_dir, checkpoint, max_files_per_trigger)
        rows, publish = listed.rows, _publish_ahead(own, listed, root, embedder, versions, options)
    else:
        rows = fl.stream_files(own, logs_dir, max_files_per_trigger=max_files_per_trigger)
    writer = rows.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if available_now else writer.start()


def _publish_ahead(
    spark: SparkSession, listed: fl.ListingStream, root: str, embedder: Embedder, versions: store.Writer, options: dict
) -> Callable[[DataFrame, int], None]:
    """Publishes a micro-batch, and meanwhile prepares those that come next, as many as half the cores.

    What was prepared becomes visible only here, in turn. It is made again if another writer changed the
    store, and what comes in another order than foreseen is prepared when it comes.
    """
    place = {name: i for i, name in enumerate(listed.order)}
    # More at once take more of the driver's memory, and publishing is not faster.
    most = max(2, spark.sparkContext.defaultParallelism // 2)
    ahead: dict[str, tuple[store.Snapshot, Future]] = {}
    pool = ThreadPoolExecutor(most)

    def prepare(name: str, held: store.Snapshot) -> str:
        listing = listed.batch(spark, name)
        small = fl.read_contents(listing.filter(F.col("file_size") <= options["max_file_bytes"]))
        return ingest.publish_fixed(
            small, listing, root, embedder, after=held, largest=listed.largest, write=store.prepare_version, **options
        )

    def publish(batch: DataFrame, _batch_id: int) -> None:
        try:
            held = versions.snapshot(spark)
            name = batch.first().listed_in
            at = place.get(name, len(place))
            for near in [name, *listed.order[at + 1 : at + 1 + most]]:
                if near not in ahead or ahead[near][0] is not held:
                    ahead[near] = held, pool.submit(prepare, near, held)
            versions.wrote(store.publish_prepared(spark, root, ahead.pop(name)[1].result(), held))
            if at + 1 >= len(place):
                pool.shutdown(wait=False)
        except BaseException:
            pool.shutdown(wait=False, cancel_futures=True)
            raise

    return publish
