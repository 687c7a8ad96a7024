import numpy as np
import pytest
from conftest import LOG_FILES
from pyspark.sql import functions as F

from kindling.cluster import new_folder, shared_folder
from kindling.functions.embedder import Embedder, hashed_words
from kindling.operators import embedding, fields, joins, quality, upsert
from kindling.plans import ingest
from kindling.plans import search as plans
from kindling.sources import store
from kindling.streaming.ingest import stream_ingest

EMBEDDER = hashed_words(16)


def snapshot(spark, root):
    return sorted((r.doc_id.split("/logs/")[1], r.chunk_idx, r.text) for r in store.read_chunks(spark, root).collect())


def expected(tree):
    out = []
    for path in tree.rglob("*.log"):
        raw = path.read_bytes()
        if raw.startswith(b"\xff\xfe"):
            text = raw[2:].decode("utf-16-le", "ignore")
        elif raw.startswith(b"\x00\x00\xfe\xff"):
            text = raw[4:].decode("utf-32-be", "ignore")
        else:
            text = raw.removeprefix(b"\xef\xbb\xbf").decode("utf-8", "ignore")
        text = text.replace("\r\n", "\n").replace("\r", "\n")
        out += [(str(path.relative_to(tree)), i, text[s : s + 300]) for i, s in enumerate(range(0, len(text), 280))]
    return sorted(out)


def counts(df):
    return tuple(df.first())


def test_ingest_replace_delete_truncate(spark, log_tree, tmp_path):
    root = str(tmp_path / "store")
    logs = len([r for r, c in LOG_FILES.items() if r.endswith(".log") and c])
    first = counts(ingest.ingest_logs(spark, str(log_tree), root, EMBEDDER))
    assert first == (logs, len(expected(log_tree)), 0)
    assert snapshot(spark, root) == expected(log_tree)
    ledger = {r.file_path: r for r in store.read_ledger(spark, root).collect()}
    assert len(ledger) == logs and {r.status for r in ledger.values()} == {"processed"}

    assert counts(ingest.ingest_logs(spark, str(log_tree), root, EMBEDDER)) == (0, 0, 0)
    assert snapshot(spark, root) == expected(log_tree)

    # A changed file that shrinks, a changed file that is now blank of text, a new path with known content.
    (log_tree / "a/n300/n.log").write_bytes(b"short")
    (log_tree / "a/w.log").write_bytes(b"\xef\xbb\xbf")
    (log_tree / "a/copy.log").write_bytes(LOG_FILES["a/x.log"])
    assert counts(ingest.ingest_logs(spark, str(log_tree), root, EMBEDDER)) == (3, 2, 0)
    assert snapshot(spark, root) == expected(log_tree)
    assert quality.duplicate_keys(store.read_chunks(spark, root), ["doc_id", "chunk_idx"]).count() == 0
    assert counts(ingest.ingest_logs(spark, str(log_tree), root, EMBEDDER)) == (0, 0, 0)

    gone = store.read_ledger(spark, root).filter(F.col("file_path").endswith("copy.log"))
    store.delete_documents(spark, root, gone.select(F.col("file_path").alias("doc_id")))
    assert snapshot(spark, root) == [r for r in expected(log_tree) if r[0] != "a/copy.log"]
    assert counts(ingest.ingest_logs(spark, str(log_tree), root, EMBEDDER)) == (1, 1, 0)
    assert snapshot(spark, root) == expected(log_tree)

    compact = str(tmp_path / "compact")
    store.compact_into(spark, root, compact)
    assert snapshot(spark, compact) == expected(log_tree)
    assert counts(ingest.ingest_logs(spark, str(log_tree), compact, EMBEDDER)) == (0, 0, 0)
    with pytest.raises(ValueError):
        store.compact_into(spark, root, compact)

    store.truncate(spark, root)
    assert snapshot(spark, root) == [] and store.read_ledger(spark, root).count() == 0
    assert counts(ingest.ingest_logs(spark, str(log_tree), root, EMBEDDER))[0] == logs + 1
    assert snapshot(spark, root) == expected(log_tree)


def test_large_files_take_the_split_route(spark, log_tree, tmp_path):
    root = str(tmp_path / "store")

    def run(**options):
        return counts(ingest.ingest_logs(spark, str(log_tree), root, EMBEDDER, max_file_bytes=250, **options))

    (log_tree / "long.log").write_bytes(("line é\r\n" * 500).encode())
    run(max_files_per_dir=1)
    first = {"long.log", "a/bom.log", "a/b/y.log", "a/n300/n.log", "a/n280/n.log"}
    assert snapshot(spark, root) == [r for r in expected(log_tree) if r[0] in first]
    run()
    assert snapshot(spark, root) == expected(log_tree)
    assert run() == (0, 0, 0)
    (log_tree / "long.log").write_bytes(("other\n" * 400).encode())
    assert run()[0] == 1
    assert snapshot(spark, root) == expected(log_tree)
    assert quality.ingest_counts(store.read_chunks(spark, root)).first().failed == 0


@pytest.mark.parametrize("fallback", ["utf-8", "latin-1"])
def test_size_does_not_change_what_is_stored(spark, log_tree, tmp_path, fallback):
    (log_tree / "a/latin.log").write_bytes("caf\u00e9 au lait\n".encode("latin-1"))
    (log_tree / "a/bad.log").write_bytes(b"\xff\xfe\xfd"[2:] * 3)
    (log_tree / "a/mark.log").write_bytes(b"\xef\xbb\xbfabc")
    (log_tree / "a/kept.log").write_bytes(b"\xef\xbf\xbd beside \xff")
    (log_tree / "a/returns.log").write_bytes(b"one. two\rthree\r\rfour" * 200)
    stored = []
    for limit in (1, 1 << 30):
        for kind, ingested in (("logs", ingest.ingest_logs), ("all", ingest.ingest_directory)):
            root = str(tmp_path / f"{kind}{limit}")
            ingested(spark, str(log_tree), root, EMBEDDER, fallback_charset=fallback, max_file_bytes=limit)
            ledger = {(r.file_path, r.content_hash, r.file_size) for r in store.read_ledger(spark, root).collect()}
            stored.append((snapshot(spark, root), ledger))
        root = str(tmp_path / f"stream{limit}")
        stream_ingest(spark, str(log_tree), root, EMBEDDER, f"{root}-checkpoint", 3, fallback_charset=fallback, max_file_bytes=limit).awaitTermination()
        stored.append((snapshot(spark, root), None))
    assert stored[0] == stored[3] and stored[1] == stored[4] and stored[2] == stored[5]
    assert stored[2][0] == stored[0][0]


def test_unfinished_version_is_invisible(spark, log_tree, tmp_path, monkeypatch):
    root = str(tmp_path / "store")
    ingest.ingest_logs(spark, str(log_tree), root, EMBEDDER)
    before = snapshot(spark, root)
    (log_tree / "a/w.log").write_bytes(b"changed")

    def fail(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(store, "_commit", fail)
        with pytest.raises(RuntimeError):
            ingest.ingest_logs(spark, str(log_tree), root, EMBEDDER)
    assert snapshot(spark, root) == before
    ingest.ingest_logs(spark, str(log_tree), root, EMBEDDER)
    assert snapshot(spark, root) == expected(log_tree)


def test_search_of_a_store(spark, log_tree, tmp_path):
    root = str(tmp_path / "store")
    ingest.ingest_logs(spark, str(log_tree), root, EMBEDDER)
    hits = plans.search_logs(spark, root, "SECOND log", EMBEDDER, 3).orderBy("rank").collect()
    assert hits[0].text == "second log\n" and hits[0].score == 1.0 and {h.score for h in hits[1:]} == {0.5}
    only = plans.search_logs(spark, root, "second log", EMBEDDER, 3, F.col("metadata")["file_name"] == "x.log").collect()
    assert [h.text for h in only] == ["one\ntwo\nthree end\n"]


def test_search_through_an_index(spark, log_tree, tmp_path):
    root = str(tmp_path / "store")
    for i in range(30):
        (log_tree / f"a/more{i}.log").write_bytes(f"event {i} in zone {i % 4} of plant {i % 7}\n".encode())
    ingest.ingest_logs(spark, str(log_tree), root, EMBEDDER)
    plans.build_index(spark, root, cells=4)

    def same(query):
        full = plans.search_logs(spark, root, query, EMBEDDER, 5).collect()
        found = plans.search_logs(spark, root, query, EMBEDDER, 5, probes=4).collect()
        assert [tuple(r) for r in sorted(found, key=lambda r: r.rank)] == [tuple(r) for r in sorted(full, key=lambda r: r.rank)]

    same("zone 3 of plant")
    same("event 7 plant")
    (log_tree / "a/more3.log").write_bytes(b"replaced, other words\n")
    (log_tree / "a/late.log").write_bytes(b"zone 3 of plant 3, later\n")
    ingest.ingest_logs(spark, str(log_tree), root, EMBEDDER)
    same("zone 3 of plant")
    same("event 3 plant")
    with pytest.raises(ValueError):
        plans.search_logs(spark, root, "x", EMBEDDER, where=F.lit(True), probes=2)
    store.delete_documents(spark, root, store.read_chunks(spark, root).filter("text LIKE '%zone 3%'").select("doc_id").distinct().limit(2))
    same("zone 3 of plant")
    # Versions start again after truncate, so the index has to go with them.
    store.truncate(spark, root)
    same("zone 3 of plant")
    ingest.ingest_logs(spark, str(log_tree), root, EMBEDDER)
    same("zone 3 of plant")
    plans.build_index(spark, root, cells=4)
    same("event 7 plant")


def test_stream_then_batch(spark, log_tree, tmp_path):
    root, checkpoint = str(tmp_path / "store"), str(tmp_path / "checkpoint")

    def run():
        stream_ingest(spark, str(log_tree), root, EMBEDDER, checkpoint, max_files_per_trigger=3).awaitTermination()

    run()
    assert snapshot(spark, root) == expected(log_tree)
    (log_tree / "a/late.log").write_bytes(b"late")
    run()
    assert snapshot(spark, root) == expected(log_tree)
    (log_tree / "a/w.log").write_bytes(b"changed")
    ingest.ingest_logs(spark, str(log_tree), root, EMBEDDER)
    assert snapshot(spark, root) == expected(log_tree)


def test_directory_ingest_reuses_vectors(spark, log_tree, tmp_path):
    root, cache, calls = str(tmp_path / "store"), str(tmp_path / "cache"), str(tmp_path / "calls")

    def load():
        def run(texts):
            with open(calls, "a") as f:
                f.writelines(t.replace("\n", " ") + "\n" for t in texts)
            return np.ones((len(texts), 2))

        return run

    model = Embedder("counting", load)
    (log_tree / "copy.txt").write_bytes(LOG_FILES["a/b/z.txt"])
    ingest.ingest_directory(spark, str(log_tree), root, model, cache)
    seen = open(calls).read().splitlines()
    assert len(seen) == len(set(seen)) and "not a log" in seen
    (log_tree / "new.txt").write_bytes(b"not a log. And more")
    (log_tree / "same.txt").write_bytes(b"not a log")
    counted = counts(ingest.ingest_directory(spark, str(log_tree), root, model, cache))
    assert counted == (2, 2, 0)
    assert open(calls).read().splitlines()[len(seen) :] == ["not a log. And more"]


def test_texts_and_cosine(spark, tmp_path):
    path = str(tmp_path / "texts")
    texts = spark.createDataFrame([("1", "disk nearly full"), ("2", "login refused"), ("3", "login refused twice"), ("4", "...")], "id string, text string")
    ingest.add_texts(texts, path, EMBEDDER)
    got = plans.similar_texts(spark, path, "Login refused", EMBEDDER, 4).orderBy("rank").collect()
    assert [r.id for r in got][:1] == ["2"] and abs(got[0].similarity - 1) < 1e-6
    assert got[-1].id == "4" and got[-1].similarity is None


def test_both_routes_of_the_ledger_check(spark):
    files = spark.createDataFrame([(f"p{i}", f"h{i}") for i in range(50)] + [("p1", "new")], "file_path string, content_hash string")
    ledger = spark.createDataFrame([(f"p{i}", f"h{i}") for i in range(0, 50, 2)] + [("x", "h1")], "file_path string, content_hash string")
    small = sorted(map(tuple, upsert.pending(files, ledger).collect()))
    assert small == sorted(map(tuple, upsert.pending(files, ledger, max_bytes=0).collect()))
    assert ("p1", "new") in small and ("p2", "h2") not in small and len(small) == 26


def test_ledger_upsert_takes_the_latest(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1")], "file_path string, content_hash string")
    old = old.withColumn("processed_at", F.timestamp_seconds(F.lit(0)))
    new = spark.createDataFrame([("a", "2", 1), ("a", "3", 2), ("c", "9", 1)], "file_path string, content_hash string, s int")
    new = new.select("file_path", "content_hash", F.timestamp_seconds("s").alias("processed_at"))
    got = {(r.file_path, r.content_hash) for r in upsert.upsert_ledger(old, new).collect()}
    assert got == {("a", "3"), ("b", "1"), ("c", "9")}


def test_lookup_with_a_hot_key(spark):
    rows = spark.range(9000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    table = spark.range(0, 9000, 2).select(F.col("id").cast("string").alias("k"), F.col("id").alias("v"))
    table = table.union(spark.createDataFrame([("hot", -1)], "k string, v long"))
    rows = rows.union(spark.createDataFrame([(-1, None)], "id long, k string"))
    split, plain = joins.lookup(rows, table, "k", max_bytes=0), joins.lookup(rows, table, "k")
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, split.collect()), key=key) == sorted(map(tuple, plain.select(split.columns).collect()), key=key)
    assert split.filter("v = -1").count() == 3000 and split.count() == 9001


def test_cache_keeps_models_apart(spark, tmp_path):
    path = str(tmp_path / "v")
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None)], "id int, text string")
    for dim in (4, 8):
        got = embedding.embed_cached(df, hashed_words(dim), path).collect()
        assert {r.id: None if r.embedding is None else len(r.embedding) for r in got} == {1: dim, 2: dim, 3: dim, 4: None}
    assert store.read_vectors(spark, path).count() == 4


def test_dimension_check(spark):
    good = spark.createDataFrame([([1.0, 2.0],), ([3.0, 4.0],), (None,)], "embedding array<float>")
    assert quality.dimension(good) == 2
    for bad in ([([1.0],), ([1.0, 2.0],)], []):
        with pytest.raises(ValueError):
            quality.dimension(spark.createDataFrame(bad, "embedding array<float>"))


def test_shared_folder_follows_the_session(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    assert new_folder(spark, "x") != new_folder(spark, "x")


def test_fields(spark):
    lines = [
        "2031-02-03 00:00:04.500 77 INFO host [0a1b2c3d-0000-4000-8000-00000000abcd] ok a=1 b=x=y a=2",
        "2031-02-03T00:59:59 ERROR 0a1b2c3d-0000-4000-8000-00000000abcd 11111111-2222-4333-8444-555555555555",
        "no time INFORMATION here",
        "2031-13-45 00:00:00 WARN bad date",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "id int, text string")
    got = {r.id: (None if r.logged_at is None else str(r.logged_at), r.level) for r in fields.time_and_level(df).collect()}
    assert got == {0: ("2031-02-03 00:00:04", "INFO"), 1: ("2031-02-03 00:59:59", "ERROR"), 2: (None, None), 3: (None, "WARN")}
    counted = {(str(r.hour), r.level): r.n_lines for r in fields.count_by_time_and_level(df).collect()}
    assert counted[("2031-02-03 00:00:00", "INFO")] == 1 and sum(counted.values()) == 4
    assert fields.key_value_fields(df).filter("id = 0").first().fields == {"a": "2", "b": "x=y"}
    vms = spark.createDataFrame([("0a1b2c3d-0000-4000-8000-00000000abcd",)], "vm_id string")
    assert sorted(r.id for r in fields.lines_of_vms(df, vms).collect()) == [0, 1]
    js = spark.createDataFrame([('{"k": 3, "s": "t"}',), ("broken",)], "j string")
    assert [(r.k, r.s) for r in fields.json_fields(js, "j", {"k": "int", "s": "string"}).collect()] == [(3, "t"), (None, None)]


def test_stream_looks_the_store_up_once(spark, log_tree, tmp_path, monkeypatch):
    """The work of a micro-batch does not grow with the versions before it."""
    root, seen = str(tmp_path / "store"), []
    read = store.read_ledger
    monkeypatch.setattr(store, "read_ledger", lambda *a: seen.append(a) or read(*a))
    stream_ingest(spark, str(log_tree), root, EMBEDDER, str(tmp_path / "c"), max_files_per_trigger=2).awaitTermination()
    assert len(seen) == 1 and snapshot(spark, root) == expected(log_tree)
    assert store.last_version(spark, root) > 2
    # Another stream over the same files: all are known.
    version = store.last_version(spark, root)
    stream_ingest(spark, str(log_tree), root, EMBEDDER, str(tmp_path / "d"), max_files_per_trigger=4).awaitTermination()
    assert store.last_version(spark, root) == version and snapshot(spark, root) == expected(log_tree)


def test_writer_sees_what_others_wrote(spark, log_tree, tmp_path):
    root = str(tmp_path / "store")
    writer = store.Writer(root)
    assert writer.snapshot(spark).version == 0 and writer.snapshot(spark).ledger is None
    ingest.ingest_logs(spark, str(log_tree), root, EMBEDDER)
    held = writer.snapshot(spark)
    assert held.version == 1 and held.ledger.count() == store.read_ledger(spark, root).count()
    writer.wrote(store.write_version(spark, root, store.read_stored(spark, root).drop("version").limit(1), held))
    assert writer.snapshot(spark) is held and held.version == 2
    store.delete_documents(spark, root, store.read_chunks(spark, root).select("doc_id").distinct())
    assert writer.snapshot(spark).version == 3 and writer.snapshot(spark).ledger is None


def test_stream_takes_a_listing_file_a_micro_batch(spark, log_tree, tmp_path, monkeypatch):
    """Paths of later micro-batches are known, and each is published in turn from what was prepared."""
    root, checkpoint = str(tmp_path / "store"), str(tmp_path / "checkpoint")
    published, publish = [], store.publish_prepared
    monkeypatch.setattr(store, "publish_prepared", lambda *a: published.append(publish(*a)) or published[-1])

    def run():
        stream_ingest(spark, str(log_tree), root, EMBEDDER, checkpoint, max_files_per_trigger=1).awaitTermination()

    run()
    listed = spark.read.parquet(f"{checkpoint}/listing")
    assert published == list(range(1, listed.count() + 1))
    assert listed.groupBy("_metadata.file_path").count().agg({"count": "max"}).first()[0] == 1
    by_version = store.read_stored(spark, root).groupBy("version").agg(F.countDistinct("doc_id").alias("n")).collect()
    assert {r.version: r.n for r in by_version} == dict.fromkeys(published, 1)
    assert list((tmp_path / "store/prepared").iterdir()) == []
    times = {r.file_path: r.modified_at for r in listed.collect()}
    order = [times[r.doc_id] for r in store.read_stored(spark, root).select("doc_id", "version").distinct().orderBy("version").collect()]
    assert order == sorted(order)
    (log_tree / "a/w.log").write_bytes(b"changed, but seen")
    (log_tree / "a/late.log").write_bytes(b"late")
    run()
    assert len(published) == spark.read.parquet(f"{checkpoint}/listing").count() == len(times) + 1
    assert {t for n, _, t in snapshot(spark, root) if n in ("a/w.log", "a/late.log")} == {"second log\n", "late"}
    run()
    assert len(published) == len(times) + 1


def test_failed_stream_goes_on_where_it_stopped(spark, log_tree, tmp_path, monkeypatch):
    root, checkpoint = str(tmp_path / "store"), str(tmp_path / "checkpoint")
    publish = store.publish_prepared

    def run():
        stream_ingest(spark, str(log_tree), root, EMBEDDER, checkpoint, max_files_per_trigger=2).awaitTermination()

    def fail_at_second(spark, root, folder, after):
        if after.version == 1:
            raise RuntimeError("lost")
        return publish(spark, root, folder, after)

    with monkeypatch.context() as m:
        m.setattr(store, "publish_prepared", fail_at_second)
        with pytest.raises(Exception, match="lost"):
            run()
    assert store.last_version(spark, root) == 1
    # Another writer takes the next version, with a file that the stream has yet to see.
    (log_tree / "a/w.log").write_bytes(b"changed")
    ingest.ingest_logs(spark, str(log_tree), root, EMBEDDER)
    assert snapshot(spark, root) == expected(log_tree)
    run()
    assert snapshot(spark, root) == expected(log_tree)


def test_stream_goes_on_from_a_checkpoint_of_sparks_source(spark, log_tree, tmp_path, monkeypatch):
    root, checkpoint = str(tmp_path / "store"), str(tmp_path / "checkpoint")

    def run():
        stream_ingest(spark, str(log_tree), root, EMBEDDER, checkpoint, max_files_per_trigger=3).awaitTermination()

    with monkeypatch.context() as m:
        m.setattr(ingest.fl, "can_stream_listing", lambda *_: False)
        run()
    version = store.last_version(spark, root)
    (log_tree / "a/late.log").write_bytes(b"late")
    run()
    assert store.last_version(spark, root) == version + 1 and not (tmp_path / "checkpoint/listing").exists()
    assert snapshot(spark, root) == expected(log_tree)


def test_stream_of_nothing(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    stream_ingest(spark, str(tmp_path / "logs"), str(tmp_path / "store"), EMBEDDER, str(tmp_path / "c")).awaitTermination()
    assert store.read_chunks(spark, str(tmp_path / "store")).count() == 0
