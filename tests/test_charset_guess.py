"""Guesses of encodings, and that cutting a file changes nothing."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindling.functions import charset
from kindling.functions import charset_guess as cg
from kindling.operators.charset import cut_pieces, guess_charsets
from kindling.plans import ingest
from kindling.sources import store

FRENCH = "L'été dernier, nous étions allés à la plage où le garçon mangeait des pâtés très salés près du château. "
GERMAN = "Über den Wäldern hängt früh ein kühler Nebel, und die Bäche führen größere Flüsse ins weiße Gebirge. "
RUSSIAN = "Сегодня очень хорошая погода, и мы идём гулять в парк, где растут высокие деревья. "
JAPANESE = "東京は日本の首都であり、世界でも有数の大都市です。カタカナもあります。今日はとても良い天気ですね。"
TEXTS = {
    "cp1252": FRENCH + GERMAN, "cp850": FRENCH + GERMAN, "mac_roman": FRENCH + GERMAN, "cp1251": RUSSIAN * 2, "koi8_r": RUSSIAN * 2,
    "cp1253": "Η Αθήνα είναι η πρωτεύουσα της Ελλάδας. Σήμερα ο καιρός είναι πολύ καλός και ο ήλιος λάμπει. ",
    "shift_jis": JAPANESE, "euc_jp": JAPANESE, "gb18030": "北京是中华人民共和国的首都，是全国的政治中心、文化中心。我们今天去学校学习中文。",
    "big5": "臺北是中華民國的首都，也是全國的政治文化中心。我們今天去學校學習中文。", "euc_kr": "서울은 대한민국의 수도이며 최대 도시이다. 오늘은 날씨가 매우 좋습니다.",
    "utf-8": FRENCH + JAPANESE + RUSSIAN, "utf-16-le": FRENCH, "utf-16-be": "plain words only",
}


@pytest.mark.parametrize("name", TEXTS)
def test_guess_of_text(name):
    raw = TEXTS[name].encode(name)
    assert cg.guess(raw) == cg.guess(raw * 30) == name


def test_short_and_odd_contents():
    assert cg.guess(b"") == cg.guess(b"plain") == "utf-8"
    assert cg.guess(FRENCH.encode()[:-1] + "é".encode()[:1]) == "utf-8"  # cut in a character
    assert cg.guess(FRENCH.encode() * 20 + b"\xff") == "utf-8"  # one broken byte
    for raw in (bytes(range(256)), b"\xff" * 1000, random.Random(1).randbytes(100_000)):
        assert cg.guess(raw) in [cg.UTF8, *cg.SINGLE_BYTE, *cg.DOUBLE_BYTE]


def test_machines_as_codecs():
    """Errors and characters of the machines against Python's strict decoders."""
    rng = random.Random(2)
    for name in ("utf-8", "euc_kr"):
        m = cg.MACHINES.index(name)
        for _ in range(400):
            parts = ["é", "한", "글", "a", " "] if name == "euc_kr" else ["é", "한", "😀", "a", " "]
            raw = "".join(rng.choice(parts) for _ in range(8)).encode(name, "ignore")
            if rng.random() < 0.5 and raw:
                at = rng.randrange(len(raw))
                raw = raw[:at] + raw[at + 1 :]
            end, errors, chars = cg.summarize(raw)[cg._TABLES :].reshape(len(cg.MACHINES), cg.STATES, 5)[m, 0, :3]
            try:
                text = raw.decode(name)
            except UnicodeDecodeError:
                assert errors or end
            else:
                assert (errors, end, chars) == (0, 0, sum(ord(c) > 127 for c in text)) or name == "utf-8" and not errors and not end


def test_any_cut_gives_the_same_summary():
    rng = random.Random(3)
    contents = [t.encode(n) * 3 for n, t in TEXTS.items()] + [rng.randbytes(5000), b"a" * 300 + b"\xe9" + b"b" * 300]
    for raw in contents:
        whole = cg.summarize(raw)
        for _ in range(5):
            cuts = sorted(rng.choices(range(len(raw) + 1), k=9))
            places = list(zip([0, *cuts], [*cuts, len(raw)]))
            parts = [cg.summarize(raw[a:b], a) for a, b in places]
            while len(parts) > 1:  # in any grouping
                i = rng.randrange(len(parts) - 1)
                parts[i : i + 2] = [cg.join(parts[i], parts[i + 1])]
            assert np.array_equal(parts[0], whole)


@pytest.mark.parametrize("piece_bytes", [1, 7, 1000])
def test_tables(spark, piece_bytes):
    rows = [(n, t.encode(n)) for n, t in TEXTS.items()] + [("none", None), ("empty", b"")]
    files = spark.createDataFrame(rows, "name string, content binary").repartition(3)
    out = {r["name"]: r for r in guess_charsets(cut_pieces(files, "name", "content", piece_bytes), "name").collect()}
    assert {n: r["charset"] for n, r in out.items()} == {n: n for n in TEXTS} | {"none": "utf-8", "empty": "utf-8"}
    assert all(out[n]["n_bytes"] == len(t.encode(n)) for n, t in TEXTS.items())


def test_decoding_by_guess(spark):
    rows = [(t, t.encode(n)) for n, t in TEXTS.items()] + [("é", b"\xef\xbb\xbf" + "é".encode()), (None, None), ("", b"")]
    df = spark.createDataFrame(rows, "text string, content binary")
    out = df.select("text", charset.decode_text(F.col("content"), charset.GUESS).alias("got")).collect()
    assert all(r["text"] == r["got"] for r in out)


@pytest.mark.parametrize("max_file_bytes", [1, 1 << 30])
def test_files_in_guessed_encodings(spark, tmp_path, max_file_bytes):
    (tmp_path / "logs").mkdir()
    for name, text in TEXTS.items():
        (tmp_path / "logs" / f"{name}.log").write_bytes(text.encode(name))
    from kindling.functions.embedder import hashed_words

    root = str(tmp_path / "store")
    ingest.ingest_logs(spark, str(tmp_path / "logs"), root, hashed_words(8), fallback_charset=charset.GUESS, max_file_bytes=max_file_bytes)
    got = {r["doc_id"].rsplit("/", 1)[1][:-4]: r["text"] for r in store.read_chunks(spark, root).filter("chunk_idx = 0").collect()}
    assert got == {n: t[:300] for n, t in TEXTS.items()}
