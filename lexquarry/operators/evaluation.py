"""Evaluation of retrieval and answers, all questions in one job; rates are rounded half to even."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexquarry.functions.text import expected_article, expected_files, holds_answer


def equivalents(pairs: DataFrame) -> DataFrame:
    """(file, same) of twin sources from (file, same): both directions and each with itself, not further."""
    return pairs.select("file", "same").unionByName(pairs.select(F.col("same").alias("file"), F.col("file").alias("same"))).unionByName(pairs.select("file", F.col("file").alias("same"))).unionByName(pairs.select(F.col("same").alias("file"), "same")).distinct()


def expected(questions: DataFrame, twins: DataFrame) -> DataFrame:
    """qid, file, same: every file that a question expects, with the files that count for it."""
    each = questions.select("qid", F.explode(expected_files(F.col("expected_source.file_path"))).alias("file"))
    own = each.select("qid", "file", F.col("file").alias("same"))
    return own.unionByName(each.join(twins, "file").select("qid", "file", "same")).distinct()


def hits_of_files(questions: DataFrame, hits: DataFrame, twins: DataFrame) -> DataFrame:
    """qid, f_ok (every expected file or a twin was hit; false if none is expected), l_ok (also the expected article, if one is named)."""
    wanted = expected(questions, twins)
    seen = hits.select("qid", F.col("file_name").alias("same"), F.col("article_no")).distinct()
    article = questions.select("qid", expected_article(F.col("expected_source.locator")).alias("want"))
    met = wanted.join(seen, ["qid", "same"], "left").join(article, "qid", "left")
    by_file = met.groupBy("qid", "file").agg(F.first("want").alias("want"))
    hit = wanted.join(seen.select("qid", "same").distinct(), ["qid", "same"], "left_semi").select("qid", "file").distinct().withColumn("ok", F.lit(True))
    files = by_file.join(hit, ["qid", "file"], "left").groupBy("qid").agg(F.bool_and(F.coalesce("ok", F.lit(False))).alias("f_ok"), F.first("want").alias("want"))
    placed = met.where("article_no = want").select("qid").distinct().withColumn("at", F.lit(True))
    out = questions.select("qid").join(files, "qid", "left").join(placed, "qid", "left")
    f_ok = F.coalesce("f_ok", F.lit(False))
    return out.select("qid", f_ok.alias("f_ok"), (f_ok & (F.col("want").isNull() | F.coalesce("at", F.lit(False)))).alias("l_ok"))


def rate(ok: Column, digits: int = 3) -> Column:
    return F.bround(F.avg(ok.cast("double")), digits)


def retrieval_metrics(questions: DataFrame, hits: DataFrame, twins: DataFrame) -> DataFrame:
    """n, file and loc rates, by format and over all (format null), without refusal questions."""
    asked = questions.where("qtype <> 'refuse'")
    rows = asked.select("qid", "format").join(hits_of_files(asked, hits, twins), "qid")
    total = F.grouping("format") == 1
    out = rows.groupingSets([["format"], []], "format").agg(F.count("*").alias("n"), total.alias("total"), F.avg(F.col("f_ok").cast("double")).alias("f"), F.avg(F.col("l_ok").cast("double")).alias("l"))
    cut = lambda c: F.when(F.col("total"), F.bround(c, 3)).otherwise(F.bround(c, 2))
    return out.select("format", "n", cut("f").alias("file_hit"), cut("l").alias("loc_hit"))


def verdicts(questions: DataFrame, answers: DataFrame, hits: DataFrame, twins: DataFrame, *, key_ok: DataFrame | None = None) -> DataFrame:
    """qid, ok, cite_ok, key_ok, refused: a refusal question is right if refused, others if cited, answered and not refused.

    key_ok: (qid, key_ok) of a judge; without one, the answer's keys decide. Citation: the expected files, or a title
    that holds the expected one or is held by it.
    """
    files = hits_of_files(questions, hits, twins).select("qid", "f_ok")
    none = F.size(expected_files(F.col("expected_source.file_path"))) == 0
    titles = hits.where("coalesce(doc_title, '') <> ''").groupBy("qid").agg(F.collect_set("doc_title").alias("titles"))
    df = questions.join(files, "qid").join(titles, "qid", "left").join(answers.select("qid", "text", "refused"), "qid")
    want = F.coalesce("expected_source.doc_title", F.lit(""))
    alike = (want != "") & F.coalesce(F.exists("titles", lambda t: F.contains(want, t) | F.contains(t, want)), F.lit(False))
    if key_ok is None:
        df = df.withColumn("key_ok", F.coalesce(holds_answer(F.col("golden_answer"), F.col("text")), F.lit(False)))
    else:
        df = df.join(key_ok.select("qid", "key_ok"), "qid", "left")
    refuse = F.col("qtype") == "refuse"
    cite = F.when(~refuse, none | F.col("f_ok") | alike)
    ok = F.when(refuse, F.col("refused")).otherwise(cite & F.coalesce("key_ok", F.lit(False)) & ~F.col("refused"))
    return df.select("qid", "qtype", "format", ok.alias("ok"), cite.alias("cite_ok"), F.when(~refuse, F.col("key_ok")).alias("key_ok"), "refused")


def full_metrics(rows: DataFrame) -> DataFrame:
    """n, accuracy, over_5s, refuse_correct of verdicts with their seconds."""
    return rows.agg(F.count("*").alias("n"), rate(F.col("ok")).alias("accuracy"), F.count_if(F.col("sec") > 5).alias("over_5s"), F.count_if(F.col("refused") & F.col("ok")).alias("refuse_correct"))


def grouped_accuracy(rows: DataFrame) -> DataFrame:
    """n and accuracy by qtype, by format and over all, in one pass."""
    out = rows.groupingSets([["qtype"], ["format"], []], "qtype", "format").agg(F.grouping_id("qtype", "format").alias("level"), F.count("*").alias("n"), F.count_if("ok").alias("ok"), rate(F.col("ok")).alias("acc"))
    return out.select(F.when(F.col("level") == 1, "qtype").when(F.col("level") == 2, "format").otherwise("all").alias("by"), F.coalesce("qtype", "format", F.lit("")).alias("value"), "n", "ok", "acc")


def judge_stats(rows: DataFrame) -> DataFrame:
    n = F.count("*")
    correct, partial = F.count_if(F.col("verdict") == "correct"), F.count_if(F.col("verdict") == "partial")
    share = lambda c: F.bround(c / F.nullif(n, F.lit(0)), 3)
    return rows.agg(n.alias("n"), correct.alias("correct"), partial.alias("partial"), (n - correct - partial).alias("incorrect"), share(correct).alias("strict_rate"), share(correct + partial).alias("lenient_rate"), F.count_if(F.col("source") == "fallback").alias("fallback_used"))


def calibration(rows: DataFrame, labels: DataFrame, *, threshold: float = 0.95) -> DataFrame:
    """n, agreement and passed of verdicts (qid, qtype, verdict) against people's (qid, human), refusal questions aside."""
    both = rows.where("qtype <> 'refuse'").join(labels, "qid").withColumn("agree", (F.col("verdict") == "correct") == F.col("human"))
    share = F.coalesce(rate(F.col("agree")), F.lit(0.0))
    return both.agg(F.count("*").alias("n"), share.alias("agreement"), (share >= threshold).alias("passed"))


def mismatches(rows: DataFrame, labels: DataFrame) -> DataFrame:
    both = rows.where("qtype <> 'refuse'").join(labels, "qid")
    return both.where((F.col("verdict") == "correct") != F.col("human")).select("qid", "human", "verdict")


def appendix(rows: DataFrame, notes: DataFrame) -> DataFrame:
    """Every verdict with a reviewer's note, if there is one, and its final state."""
    state = F.when(F.col("ok"), "pass").when(F.col("note").isNotNull(), "reviewed").otherwise("fail")
    return rows.join(notes, "qid", "left").select("qid", "ok", "note", state.alias("state"))


def write_detail(rows: DataFrame, path: str) -> None:
    """Every question's outcome as JSON lines."""
    rows.write.mode("overwrite").json(path)
