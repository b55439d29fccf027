"""What grows with the tables is spread over tasks, or bounded in one."""

import corpora
import numpy as np
import pytest
from lexquarry.operators import bm25, dense, ivf, structure, words
from lexquarry.plans.queries import QUERIES
from lexquarry.sources import files
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.1"


def test_sheets_are_made_and_read_by_several_tasks(spark):
    """The part table is a small file, which one task would read."""
    assert QUERIES["sheet_reader"](spark, SF).select(F.spark_partition_id().alias("task")).distinct().count() >= 4


def test_sheet_rows_are_handed_on_while_files_are_read(spark, monkeypatch):
    """Bad and empty files among others, and columns that are kept, in pieces of a few rows."""
    monkeypatch.setattr(files, "_ROWS", 3)
    sheet = bytearray(corpora.sheet_file(corpora.GRID))
    docs = spark.createDataFrame([(1, sheet, "a"), (2, bytearray(b"no zip"), "b"), (3, bytearray(corpora.sheet_file([])), None), (4, None, "d"), (5, sheet, "e")], "id long, content binary, path string").coalesce(1)
    rows = files.read_sheets(docs, key="id", keep=("path",)).collect()
    assert [r.id for r in rows] == sorted(r.id for r in rows) and all((r.path or "") == {1: "a", 2: "b", 3: "", 4: "d", 5: "e"}[r.id] for r in rows)
    of = {i: [(r.sheet_no, r.sheet_name, r.row, r.cells, r.kinds, r.status) for r in rows if r.id == i] for i in range(1, 6)}
    assert of[1] == of[5] and len(of[1]) > 3 and {s for *_, s in of[1]} == {"OK"}
    assert of[3] == [(None, None, None, None, None, "OK")] and [s[:5] for *_, s in of[2] + of[4]] == ["ERROR", "ERROR"]


@pytest.mark.parametrize("opened", [None, 0.5, 1.0])
def test_copies_and_many_questions_stay_bounded_in_a_task(spark, monkeypatch, opened):
    """Of a thousand copies a task keeps those that can be ranked; scores are taken in small pieces, with the same result."""
    monkeypatch.setattr(dense, "SCORES", 1 << 10)
    rng = np.random.default_rng(5)
    v = rng.standard_normal((1500, 8))
    v[300:1300] = v[7] * rng.uniform(0.5, 2, (1000, 1))
    cells = rng.integers(0, 6, 1500)
    df = spark.createDataFrame([(i, x.tolist(), int(c)) for i, (x, c) in enumerate(zip(v, cells, strict=True))], "vec_id long, embedding array<double>, cell int").coalesce(1)
    asked = v[[7, 20, 300, 500, 1400]]
    asked = asked / np.sqrt((asked * asked).sum(axis=1))[:, None]
    probes = None if opened is None else np.ones((5, 6), bool) if opened == 1 else rng.random((5, 6)) < opened
    found = dense.nearest(df, list(range(5)), asked, df.schema["vec_id"], key="vec_id", k=4, probes=probes)
    assert found.count() <= 5 * 4 * 3
    got = {(r.qid, r["rank"]): (r.vec_id, r.score) for r in dense.ranked(found, "vec_id", 4).collect()}
    scores = asked @ (v / np.sqrt((v * v).sum(axis=1))[:, None]).T
    if probes is not None:
        scores = np.where(probes[:, cells], scores, -9)
    for q in range(5):
        want = sorted((-round(x, 6), i) for i, x in enumerate(scores[q]) if x > -9)[:4]
        assert [got[q, r + 1] for r in range(len(want))] == [(i, -x) for x, i in want]
    filed = ivf.assign(df.drop("cell"), asked[[0, 1, 4]]).collect()
    assert [r.cell for r in filed] == np.argmax(v @ asked[[0, 1, 4]].T, axis=1).tolist()


def test_markdown_lines_are_followed_without_a_shuffle(spark):
    """Nothing of a document waits for others: no exchange, no sort; where batches end makes no difference."""
    some = ["# a", "## b", "### c", "| x | y |", "| --- | --- |", "| 1 | 2 |", "- item", "", "text"]
    docs = spark.createDataFrame([(i, "\n".join(some[(i * k + k * k) % 9] for k in range(i % 30))) for i in range(60)], "doc_id long, text string").coalesce(1)
    found = structure.markdown_elements(docs)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan
    whole = found.collect()
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert structure.markdown_elements(docs).collect() == whole and len(whole) > 300
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_words_are_counted_from_distinct_runs(spark):
    """A run that repeats is cut into sequences once, and counts as often as it occurs."""
    texts = spark.createDataFrame([("税务机关",)] * 40 + [("机关税务",)] * 3, "text string")
    found = words.dictionary(texts)
    assert "hashpartitioning(run" in found._jdf.queryExecution().executedPlan().toString()
    assert {r.word: r.n for r in found.where("length(word) = 1").collect()} == dict.fromkeys("税务机关", 43)


def test_document_frequencies_need_one_shuffle_of_counts(spark):
    rows = [(i, f"d{i}", "t1", f"w{i % 3}-x, w{i % 3}-x, y", 1) for i in range(30)]
    index = bm25.build(spark.createDataFrame(rows, "chunk_ix long, doc_id string, doc_title string, text string, is_latest int"))
    found = index.doc_freq()
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted(found.collect()) == sorted(bm25.doc_freq(index.postings()).collect())
