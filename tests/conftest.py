import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("kindling-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    from kindling.cluster import ship

    ship(session)
    yield session
    session.stop()


LOG_FILES = {
    "a/x.log": b"one\r\ntwo\rthree\xff end\n",
    "a/w.log": b"second log\n",
    "a/b/y.log": "café über \U0001f600 done".encode(),
    "a/b/z.txt": b"not a log",
    "a/u16.log": b"\xff\xfe" + "wide é\n".encode("utf-16-le") + b"\x41",
    "a/u32.log": b"\x00\x00\xfe\xff" + "wider\n".encode("utf-32-be"),
    "a/bom.log": b"\xef\xbb\xbfmarked\n",
    "a/empty/e.log": b"",
    "a/n300/n.log": b"x" * 300,
    "a/n280/n.log": b"y" * 280,
    "UPPER.LOG": b"wrong case",
}

# What each .log file reads as.
LOG_TEXTS = {
    "x.log": "one\ntwo\nthree end\n",
    "w.log": "second log\n",
    "y.log": "café über \U0001f600 done",
    "u16.log": "wide é\n",
    "u32.log": "wider\n",
    "bom.log": "marked\n",
}


@pytest.fixture
def log_tree(tmp_path):
    for rel, content in LOG_FILES.items():
        target = tmp_path / "logs" / rel
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(content)
    return tmp_path / "logs"
