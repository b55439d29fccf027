"""Postings in blocks give the rows of the plain index, from fewer postings."""

import random
import re

import pytest
from lexquarry.operators import blocks, bm25
from pyspark.sql import functions as F

FIELDS = "chunk_ix long, doc_id string, doc_title string, text string, is_latest int, row_range string"


def corpus(spark, n=6000):
    """Common words are in most chunks, others in few; some chunks are equal, some rows of tables, some superseded."""
    rng = random.Random(11)
    rows = []
    for i in range(n):
        common = " ".join(f"common{rng.randint(0, 5)}" for _ in range(rng.randint(1, 12)))
        some = " ".join(f"some{int(rng.paretovariate(0.7))}" for _ in range(4))
        rows.append((i, f"d{i // 5}", f"title{i % 50}", f"{common}-{some}" if i % 9 else "same common1 text", int(i % 4 > 0), f"r{i}" if i % 3 == 0 else None))
    return spark.createDataFrame(rows, FIELDS)


def questions(spark):
    asked = ["common0 common1 some7 some900", "some3", "common2", "same text", "nothing of it", "", None, "common1 common1 common3 some12 some12 some55", "title7 some2", "common5 some40 some41 some42"]
    return spark.createDataFrame([(f"q{i}", a, i % 2 == 0) for i, a in enumerate(asked)], "qid string, question string, include_history boolean")


def words(text):
    return F.regexp_extract_all(text, F.lit("([a-z]+[0-9]*)"), F.lit(1))


def hits(df):
    return sorted((r.qid, r.rank, r.chunk_ix, r.score, r.text) for r in df.collect())


@pytest.fixture(scope="module")
def plain(spark):
    chunks = corpus(spark).repartition(6).cache()
    return bm25.build(chunks, tokenizer=words)


@pytest.fixture(scope="module")
def saved(spark, plain, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("blocks"))
    blocks.build(plain, block=64).save(folder, buckets=4)
    return folder


@pytest.mark.parametrize("drilldown", [False, True])
@pytest.mark.parametrize("k", [1, 5, 50])
def test_rows_are_those_of_the_plain_index(spark, plain, saved, k, drilldown):
    index = blocks.Index.load(spark, saved, tokenizer=words)
    assert hits(index.retrieve(questions(spark), k=k, drilldown=drilldown)) == hits(plain.retrieve(questions(spark), k=k, drilldown=drilldown))


def test_blocks_hold_each_posting_once(spark, plain, saved):
    index = blocks.Index.load(spark, saved)
    each = index.blocks.select("term", "block", "n", "w", F.inline("postings"))
    assert sorted(map(tuple, each.select("term", "chunk_ix", "tf", "dl").collect())) == sorted(map(tuple, plain.postings().select("term", "chunk_ix", "tf", "dl").collect()))
    sizes = index.blocks.select("n", F.size("postings").alias("m"), "part").collect()
    assert all(r.n == r.m <= 64 for r in sizes) and {r.part for r in sizes} == set(range(blocks.PARTS))
    k1, b, avgdl = index.stats["k1"], index.stats["b"], index.stats["avgdl"]
    top = each.groupBy("term", "block").agg(F.max(F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / avgdl))).alias("m"), F.first("w").alias("w"))
    assert top.where("abs(m - w) > 1e-9").isEmpty()


def test_common_terms_are_hardly_opened(spark, saved):
    """A question of common terms and a rare one opens a fifth of their postings at most."""
    index = blocks.Index.load(spark, saved, tokenizer=words)
    asked = spark.createDataFrame([("a", "common0 common1 common2 some900 some901 title7"), ("b", "common4 common5 some700")], "qid string, question string")
    terms = bm25.question_terms(asked, tokenizer=words)
    opened, bounds = index.opened(terms, asked.select("qid", F.lit(True).alias("include_history")), k=5)
    all_ = index._asked_blocks(terms).groupBy("qid").agg(F.sum("n").alias("n")).collect()
    few = {r.qid: r.n for r in opened.groupBy("qid").agg(F.sum("n").alias("n")).collect()}
    assert len(all_) == 2 and all(5 * few[r.qid] <= r.n for r in all_), (few, all_)
    assert all(r.rest < r.bound for r in bounds.collect())


def test_postings_are_not_shuffled(spark, saved):
    """Questions are dealt to the buckets; nothing stands between the scan of postings and the join."""
    index = blocks.Index.load(spark, saved, tokenizer=words)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        terms = bm25.question_terms(questions(spark), tokenizer=words)
        each = terms.select("qid", "term", F.explode(F.sequence(F.lit(0), F.lit(blocks.PARTS - 1))).alias("part"))
        plan = index.blocks.select("term", "part", "postings").join(each, ["term", "part"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SelectedBucketsCount: 4 out of 4" in plan and "SortMergeJoin" in plan
    scan = next(i for i, x in enumerate(plan.splitlines()) if "FileScan parquet" in x and "postings" in x)
    depth = lambda x: len(re.match(r"[\s:+|-]*", x)[0])
    above = [x for i, x in enumerate(plan.splitlines()[:scan]) if depth(x) < depth(plan.splitlines()[scan]) and all(depth(y) > depth(x) for y in plan.splitlines()[i + 1 : scan + 1])]
    assert above and not any("Exchange" in x for x in above), plan


def test_empty(spark, plain, saved):
    none = bm25.build(corpus(spark, 50).where("false"), tokenizer=words)
    assert blocks.build(none).kept().retrieve(questions(spark)).collect() == []
    index = blocks.Index.load(spark, saved, tokenizer=words)
    assert index.retrieve(questions(spark).where("false")).collect() == []


def test_disk_few_shuffles(spark, plain, saved, monkeypatch):
    """Postings are shuffled once, to order them; tokens stay where they lie, also where more chunks are wanted than are broadcast."""
    made = blocks.build(plain, block=64)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert plan(made.blocks).count("Exchange") == 1 and "Exchange rangepartitioning(term" in plan(made.blocks)
    index = blocks.Index.load(spark, saved, tokenizer=words)
    asked = index._known(terms := bm25.question_terms(questions(spark), tokenizer=words), index._asked_blocks(terms))
    wanted = spark.createDataFrame([("q0", f"d{i // 5}", i) for i in range(40)], "qid string, doc_id string, chunk_ix long")
    expected = hits(plain.retrieve(questions(spark)))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(full := index.exact(asked, wanted, pairs=True))
        assert "hashpartitioning(doc_id" not in text and "BroadcastHashJoin [doc_id" in text, text
        some = {tuple(r) for r in full.collect()}
        monkeypatch.setattr(bm25, "BROADCAST_TERMS", 0)
        text = plan(full := index.exact(asked, wanted, pairs=True))
        assert some and {tuple(r) for r in full.collect()} == some
        join = next(i for i, x in enumerate(text.splitlines()) if "hashpartitioning(doc_id" in x)
        assert any("term" in x and "LeftSemi" in x for x in text.splitlines()[join:]), text
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert hits(made.kept().retrieve(questions(spark))) == expected


@pytest.mark.parametrize("limit", [None, 0])
def test_chunks_that_repeat_count_together(spark, monkeypatch, limit):
    """As in bm25.Index.postings(): rows that agree in all that postings carry are one chunk; nulls are a key like others."""
    if limit is not None:
        monkeypatch.setattr(bm25, "BROADCAST_TERMS", limit)
    rows = [(1, "a", "t", "x y x", 1, None), (1, "a", "t", "x y x", 1, None), (2, "b", None, "x", 1, None), (None, "c", "t", "x y", 1, "r"), (None, "c", "t", "x y", 1, "r"), (3, None, "", "y", None, None), (4, "d", "t", "", 0, None), (5, "e", None, None, 0, None)]
    index = bm25.build(spark.createDataFrame(rows, FIELDS), tokenizer=words)
    fields = ("chunk_ix", "doc_id", "is_latest", "dl", "term", "tf")
    expected = sorted(map(repr, index.postings().select(*fields).collect()))
    made = blocks.build(index)
    assert sorted(map(repr, made.blocks.select("term", F.inline("postings")).select(*fields).collect())) == expected
    assert sorted(map(repr, blocks._postings(made.cut, 3).select(*fields).collect())) == expected
