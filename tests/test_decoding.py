"""Files that are not clean UTF-8: what can be read is read, and no file ends the job for the others."""

import random

import corpora
import duckdb
import pytest
from lexquarry.functions.text import decoded
from lexquarry.plans import corpus
from lexquarry.plans.queries import ORACLES, QUERIES
from lexquarry.sources import files
from lexquarry.streaming.registry import watch
from pyspark.sql import functions as F


def plain(content: bytes) -> str:
    return content.decode("utf-8", errors="replace").replace("\r\n", "\n").replace("\r", "\n")


def test_every_kind_of_broken_bytes(spark):
    rng = random.Random(2)
    parts = [b"\xff", b"\xc0\xaf", b"\xe6\xa0", b"\xe6\xa0\x87", b"\xf0\x9f\x98\x80", b"\xf0\x9f\x98", b"\xf0\x9f", b"\xed\xa0\x80", b"\xf4\x90\x80\x80", b"\x80", b"\r", b"\n", b"a", b"\xc3\xa9", b"\xc3", b"\xe0\x80\x80", b"\xef\xbb\xbf", b"\x00"]
    rows = [b"".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in range(400)] + [bytes(rng.randrange(256) for _ in range(30)) for _ in range(100)]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, content binary")
    got = {r.i: r.text for r in df.select("i", decoded(F.col("content")).alias("text")).collect()}
    assert got == {i: plain(b) for i, b in enumerate(rows)}
    assert df.limit(1).select(decoded(F.lit(None).cast("binary")).alias("t")).first().t is None


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "corpus").mkdir()
    (tmp_path / "md").mkdir()
    (tmp_path / "corpus" / "good.txt").write_text(corpora.LAW, encoding="utf-8")
    (tmp_path / "corpus" / "gbk.txt").write_bytes("标题：国标文件\n正文：\n第一段\n".encode("gbk") + b"plain line\r\nlast")
    (tmp_path / "corpus" / "half.txt").write_bytes("正文：\r\n完好的一行\r".encode() + b"\xe6\xa0\n" + "标题".encode()[:4])
    (tmp_path / "corpus" / "bad.docx").write_bytes(b"PK\x03\x04 not a zip")
    (tmp_path / "md" / "手册_1.md").write_text("# 手册\r\n\r\n瑞郎说明\r\n", encoding="utf-8")
    (tmp_path / "md" / "坏_1.md").write_bytes("# 坏".encode("gbk"))
    return tmp_path


def test_registry_elements_and_chunks_of_broken_files(spark, folder):
    root = str(folder / "corpus")
    records = corpus.build_registry(spark, root)
    by = {r.file_path: r for r in records.collect()}
    assert {p: r.status.split(":")[0] for p, r in by.items()} == {"good.txt": "OK", "gbk.txt": "OK", "half.txt": "OK", "bad.docx": "ERROR"}
    assert by["good.txt"].doc_title == "税收征管办法" and by["half.txt"].doc_title == "完好的一行"
    markdown = files.scan_markdown(spark, str(folder / "md"))
    assert {r.file_path: r.status for r in markdown.collect()} == {"手册_1.md": "OK", "坏_1.md": "ERROR: not UTF-8"}
    found = corpus.elements(spark, root, corpus.finalize(records), markdown).collect()
    texts = {}
    for e in found:
        texts.setdefault(e.doc_id, []).append(e.text)
    assert texts[by["half.txt"].doc_id] == ["完好的一行", "�", "标�"]
    assert texts[by["gbk.txt"].doc_id][-2:] == ["plain line", "last"]
    made = corpus.chunks(spark, root, corpus.finalize(records), markdown).collect()
    assert any("瑞郎说明" in c.text for c in made) and not any(c.file_name == "坏_1.md" for c in made)


def test_stream_of_broken_files(spark, folder):
    target = str(folder / "out")
    watch(spark, str(folder / "corpus"), target, str(folder / "ck")).awaitTermination(180)
    got = {r.file_path: r.fingerprint for r in spark.read.parquet(target).collect()}
    assert got == {r.file_path: r.fingerprint for r in corpus.build_registry(spark, str(folder / "corpus")).collect()}


def test_query_agrees_with_its_sql(spark):
    con = duckdb.connect()
    con.execute("create view orders as select * from '/root/testdata/sf0.001/orders.parquet'")
    got = QUERIES["text_decoding"](spark, "/root/testdata/sf0.001")
    assert sorted(map(tuple, got.select("o_orderkey", "text").collect())) == sorted(con.execute(ORACLES["text_decoding"]).fetchall())
