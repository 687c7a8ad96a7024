import hashlib

from conftest import LOG_FILES, LOG_TEXTS
from pyspark.sql import functions as F

from kindling.functions import charset
from kindling.functions.text import normalize_newlines
from kindling.plans import ingest
from kindling.sources import files as fl


def rel(path, root):
    return path.split(str(root) + "/", 1)[1]


def expected_logs():
    return {r: c for r, c in LOG_FILES.items() if r.endswith(".log") and c}


def test_scan_is_recursive_and_case_sensitive(spark, log_tree):
    rows = fl.content_hash(fl.scan_files(spark, str(log_tree))).collect()
    got = {rel(r.file_path, log_tree): (r.content_hash, r.file_size, bytes(r.content)) for r in rows}
    assert got == {r: (hashlib.sha256(c).hexdigest(), len(c), c) for r, c in expected_logs().items()}


def test_scan_without_glob_takes_every_file(spark, log_tree):
    got = {rel(r.file_path, log_tree) for r in fl.list_files(spark, str(log_tree), glob=None).collect()}
    assert got == {r for r, c in LOG_FILES.items() if c}


def test_first_files_per_directory(spark, log_tree):
    for n in (1, 2):
        by_dir = {}
        for r in sorted(expected_logs()):
            by_dir.setdefault(r.rsplit("/", 1)[0], []).append(r)
        expected = {r for names in by_dir.values() for r in names[:n]}
        files = fl.scan_files(spark, str(log_tree), max_files_per_dir=n)
        assert {rel(r.file_path, log_tree) for r in files.collect()} == expected


def test_files_above_the_limit_are_left_out(spark, log_tree):
    got = {rel(r.file_path, log_tree) for r in fl.scan_files(spark, str(log_tree), max_bytes=299).collect()}
    assert got == {r for r, c in expected_logs().items() if len(c) < 300}


def test_decoding(spark, log_tree):
    docs = ingest.log_documents(fl.content_hash(fl.scan_files(spark, str(log_tree))), author="me").collect()
    texts = {d.metadata["file_name"]: d.text for d in docs if d.metadata["file_name"] in LOG_TEXTS}
    assert texts == LOG_TEXTS
    assert all(d.metadata["category"] == "log" and d.metadata["author"] == "me" for d in docs)


def test_fallback_charset_and_genuine_replacement_character(spark):
    rows = [(b"caf\xe9",), ("kept �".encode(),), (None,), (b"",)]
    df = spark.createDataFrame(rows, "content binary")
    decoded = [r.t for r in df.select(charset.decode_text(F.col("content"), "latin-1").alias("t")).collect()]
    assert decoded == ["café", "kept �", None, ""]


def test_newlines(spark):
    df = spark.createDataFrame([("a\r\nb\rc\nd\r\r\ne",)], "t string")
    assert df.select(normalize_newlines(F.col("t"))).first()[0] == "a\nb\nc\nd\n\ne"


def test_visitor_and_streamed_hash(spark, log_tree):
    listing = fl.list_files(spark, str(log_tree))
    got = {rel(r.file_path, log_tree): r.result for r in fl.visit_files(listing, fl.streamed_sha256).collect()}
    assert got == {r: hashlib.sha256(c).hexdigest() for r, c in expected_logs().items()}


def test_written_tree_reads_back(spark, tmp_path):
    rows = [(f"d{i % 3}/f {i}.log", f"text {i}".encode()) for i in range(20)]
    fl.write_tree(spark.createDataFrame(rows, "rel_path string, content binary"), str(tmp_path / "t"))
    assert {str(p.relative_to(tmp_path / "t")): p.read_bytes() for p in (tmp_path / "t").rglob("*.log")} == dict(rows)
    listing = fl.list_files(spark, str(tmp_path / "t"))
    assert {r.result for r in fl.visit_files(listing, fl.streamed_sha256).collect()} == {
        hashlib.sha256(c).hexdigest() for _, c in rows
    }


def test_listing_by_tasks_is_as_sparks(spark, tmp_path):
    """Names, addresses, times and sizes as of Spark's listing, which a pattern that only Hadoop knows brings back."""
    root = tmp_path / "odd root%20é"
    names = ["a.log", "b c.log", "d%41.log", "e#f?.log", "[x].log", "é ü　.log", "q'(1)!~*,;&=+$@.log", '"<>|\\^`{}.log', ".h.log", "_h.log", "_k=1.log", "c.log._COPYING_", "n.txt", "A.LOG", "_metadata.log"]
    for folder in ("", "sub", "sub/deep er", "_part=1", "_gone", ".gone", "_metadata", "nothing"):
        (root / folder).mkdir(parents=True, exist_ok=True)
        for name in names if folder != "nothing" else []:
            (root / folder / name).write_bytes(f"{folder} {name}".encode())
    (root / "sub/empty.log").write_bytes(b"")
    for ours, sparks in ((fl.LOG_GLOB, "{*.log}"), (None, "{*,*}")):
        for form in (f"{root}", f"file://{root}/"):
            got, expected = (sorted(map(tuple, fl.list_files(spark, form, glob).collect())) for glob in (ours, sparks))
            assert got == expected and len(got) > 40
        got, expected = (sorted(map(tuple, fl.scan_files(spark, str(root), glob, max_bytes=20).collect())) for glob in (ours, sparks))
        assert got == expected


def test_listing_is_not_held_by_the_driver(spark, log_tree):
    """Spark's own index of files, one object a file, takes no part in listing or scanning a tree."""
    for files in (fl.list_files(spark, str(log_tree)), fl.scan_files(spark, str(log_tree)), fl.scan_files(spark, str(log_tree), max_files_per_dir=1)):
        plan = files._jdf.queryExecution().optimizedPlan().toString().lower()
        assert "binaryfile" not in plan and not any(f.endswith(".log") for f in files.inputFiles())


def test_contents_are_held_a_batch_at_a_time(spark, tmp_path, monkeypatch):
    for i in range(40):
        (tmp_path / f"{i}.log").write_bytes(b"%d" % (i % 10) * (1000 + i))
    monkeypatch.setattr(fl, "_BATCH_BYTES", 3000)
    files = fl.read_contents(fl.list_files(spark, str(tmp_path)).coalesce(1))
    sizes = files.select("file_size", "content").mapInArrow(lambda it: it, "file_size long, content binary")
    assert all(len(r.content) == r.file_size for r in sizes.collect()) and sizes.count() == 40
