"""The inverted file against the exact scan."""

import numpy as np
import pytest
from lexquarry.operators import dense, ivf
from lexquarry.plans.queries import QUERIES
from pyspark.sql import functions as F


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((24, 16))
    v = centres[rng.integers(0, 24, 3000)] + 0.5 * rng.standard_normal((3000, 16))
    v[2000:2900] = v[0]  # a third of one cell
    rows = [(i, x.tolist(), int(i % 3 > 0), f"t{i}") for i, x in enumerate(v)]
    rows += [(3000, None, 1, "null"), (3001, [0.0] * 16, 1, "zero"), (3002, [1.0] * 3, 1, "short"), (3003, [float("nan")] * 16, 1, "nan"), (3004, [], 1, "empty"), (3005, [None] * 16, 1, "nulls")]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, is_latest int, text string").repartition(4).cache()


def recall(got, want):
    return len(set(got) & set(want)) / len(want)


def test_saved_index(spark, clustered, tmp_path):
    ivf.build(clustered, cells=32).save(str(tmp_path))
    index = ivf.Index.load(spark, str(tmp_path))
    assert len(index.centres) == 32
    asked = clustered.where("vec_id % 40 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    exact = rows_of(dense.top_k(clustered, asked), "qid", "rank", "vec_id", "score")
    assert rows_of(index.top_k(asked, nprobe=32), "qid", "rank", "vec_id", "score") == exact
    few = rows_of(index.top_k(asked, nprobe=4), "qid", "rank", "vec_id", "score")
    assert len(few) == len(exact) and recall(few, exact) >= 0.95
    latest = rows_of(dense.top_k(clustered, asked, latest_only=True), "qid", "rank", "vec_id", "score")
    assert rows_of(index.top_k(asked, nprobe=32, latest_only=True), "qid", "rank", "vec_id", "score") == latest
    # one question reads the files of its cells only
    one = asked.where("qid = 40")
    plan = index.opened([3, 5])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan or "PartitionFilters: [cell" in plan
    files = lambda df: df.select(F.input_file_name().alias("f")).distinct().count()
    assert files(index.opened([3, 5])) == 2 < files(index.vectors) / 10
    assert {r.vec_id for r in index.top_k(one, nprobe=2).collect()} == {v for q, _, v, _ in exact if q == 40}


def test_upsert_and_delete_touch_their_cells(spark, clustered, tmp_path):
    import os

    ivf.build(clustered, cells=16).save(str(tmp_path))
    index = ivf.Index.load(spark, str(tmp_path))
    before = {d: sorted(os.listdir(tmp_path / "cells" / d)) for d in os.listdir(tmp_path / "cells") if d.startswith("cell=")}
    alone = index.vectors.where("vec_id = 7").first().cell
    more = spark.createDataFrame([(7, index.centres[5].tolist(), 1, "moved"), (9000, (-index.centres[5]).tolist(), 0, "new"), (9001, None, 1, "none")], "vec_id long, embedding array<double>, is_latest int, text string")
    index.upsert(more)
    after = {d: sorted(os.listdir(tmp_path / "cells" / d)) for d in os.listdir(tmp_path / "cells") if d.startswith("cell=")}
    moved = {r.vec_id: (r.cell, r.text) for r in index.vectors.where("vec_id in (7, 9000, 9001)").collect()}
    assert moved[7] == (5, "moved") and moved[9001] == (None, "none") and index.vectors.count() == 3008
    touched = {f"cell={c}" for c in (alone, 5, moved[9000][0])} | {"cell=__HIVE_DEFAULT_PARTITION__"}
    assert {d for d in before if before[d] != after.get(d)} <= touched
    want = clustered.where("vec_id <> 7").unionByName(more)
    asked = more.where("vec_id <> 9001").select(F.col("vec_id").alias("qid"), "embedding")
    assert rows_of(index.top_k(asked, nprobe=16), "qid", "rank", "vec_id", "score") == rows_of(dense.top_k(want, asked), "qid", "rank", "vec_id", "score")
    # a cell that loses its last vector goes too
    gone = index.vectors.where(f"cell = {moved[9000][0]} or vec_id = 3000").select("vec_id")
    left = index.vectors.join(gone, "vec_id", "left_anti").count()
    index.delete(spark.createDataFrame(gone.collect(), "vec_id long"))
    assert index.vectors.count() == left and index.vectors.where(f"cell = {moved[9000][0]}").isEmpty()
    assert ivf.Index.load(spark, str(tmp_path)).vectors.count() == left


def test_empty_and_single(spark, clustered):
    none = clustered.where("false")
    asked = clustered.where("vec_id = 1").select(F.col("vec_id").alias("qid"), "embedding")
    assert ivf.build(none).top_k(asked).collect() == []
    one = clustered.where("vec_id in (1, 3000)")
    assert [(r.vec_id, r.score) for r in ivf.build(one).top_k(asked).collect()] == [(1, 1.0)]
    assert ivf.build(clustered, cells=4).top_k(asked.where("false")).collect() == []


def test_recall_of_the_query(spark):
    sf = "/root/testdata/sf0.1"
    got, want = (rows_of(QUERIES[n](spark, sf), "qid", "vec_id") for n in ("dense_ivf_topk", "dense_topk_cosine"))
    assert recall(got, want) >= 0.9
