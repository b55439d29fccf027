"""Answers: triage of the evidence, prompts, calls of a language model by the caller's function, refusals, verdicts of a judge."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexquarry.functions.text import REFUSAL, holds_answer, refuses
from lexquarry.session import kept
from lexquarry.sources.files import exists

# What is answered without evidence to be trusted, and how prompts are worded.
LOW_TRUST = "找到疑似相关内容,但无法可信溯源,不作答。"
NO_JUDGE = "LLM-judge 不可用,回退字符串粗判"
UNPLACED = "【来源定位不完整】"
#: What a model is told before it answers; the refusal must be REFUSAL, word for word, to be known as one.
SYSTEM = f"你负责回答法规问题。答案只能来自给出的【检索到的法规内容】，不许动用其他知识，也不许推断或补充；数字、日期和文号照原文写。请在末尾以 [1][2] 的形式标出依据。内容不够回答时，只写：「{REFUSAL}」"


def judge_prompt(question: Column, golden: Column, answer: Column) -> Column:
    """What a judge is asked: the question and both answers, nothing of retrieval or citations."""
    rules = (
        "请对照标准答案给模型答案评分。只看问题问到的内容：标准答案里多出的说明不作要求，措辞、顺序和引用编号也不计。"
        "问到的事实、数字、日期、文号都对（数值只是精度不同也算对）为 correct；问了几点而只答对一部分为 partial；"
        "有错、相互矛盾或拒绝回答为 incorrect。只输出一行 JSON：{\"verdict\": \"correct|partial|incorrect\", \"reason\": \"30 字以内\"}"
    )
    blank = lambda c: F.coalesce(c, F.lit(""))
    return F.concat(F.lit(f"{rules}\n\n【问题】\n"), blank(question), F.lit("\n\n【标准答案】\n"), blank(golden), F.lit("\n\n【模型答案】\n"), blank(answer))



def triage(questions: DataFrame, hits: DataFrame, *, min_score: float | None = None) -> DataFrame:
    """qid, n_hits, n_low and verdict of each question: refuse_no_hit, refuse_low_trust (all grade C), degraded (some), ok."""
    if min_score is not None:
        hits = hits.where(F.col("score") >= min_score)
    counted = hits.groupBy("qid").agg(F.count("*").alias("n_hits"), F.count_if(F.col("citation_level") == "C").alias("n_low"))
    zero = F.lit(0).cast("long")
    out = questions.select("qid").join(counted, "qid", "left").select("qid", F.coalesce("n_hits", zero).alias("n_hits"), F.coalesce("n_low", zero).alias("n_low"))
    verdict = F.when(F.col("n_hits") == 0, "refuse_no_hit").when(F.col("n_low") == F.col("n_hits"), "refuse_low_trust").when(F.col("n_low") > 0, "degraded").otherwise("ok")
    return out.withColumn("verdict", verdict)


def prompts(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """qid, prompt, citations and chunks used, from hits (qid, rank, citation, citation_level, text, chunk_id)."""
    block = F.struct("rank", "citation", "citation_level", "text", "chunk_id")
    all_ = hits.groupBy("qid").agg(F.array_sort(F.collect_list(block)).alias("hits"))
    tag = lambda h: F.when(h["citation_level"] == "C", UNPLACED).otherwise("")
    shown = F.transform("hits", lambda h, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), h["citation"], tag(h), F.lit("\n"), h["text"]))
    text = F.concat(F.lit("【检索到的法规内容】\n"), F.array_join(F.coalesce(shown, F.array().cast("array<string>")), "\n\n"), F.lit("\n\n【问题】\n"), F.col("question"))
    each = lambda f: F.coalesce(F.transform("hits", lambda h: h[f]), F.array().cast("array<string>"))
    return questions.select("qid", "question").join(all_, "qid", "left").select("qid", text.alias("prompt"), each("citation").alias("citations"), each("chunk_id").alias("chunks_used"))


def call_model(df: DataFrame, model: Callable[[str], str], *, prompt: str = "prompt", out: str = "answer", seconds: str | None = None, tries: int = 1, fit: Callable[[str], bool] | None = None, strict: bool = False, at_once: int = 8, pause: float = 0.5) -> DataFrame:
    """Adds the model's answer to each prompt (null prompts aren't sent), by so many tries until it is fit, and how many seconds it took.

    A task asks for `at_once` prompts at a time, in order; between tries it waits, first `pause` seconds, then twice as
    long each time. A prompt that no try answered has null; with strict the last error ends the job.
    """

    def one(text: str | None) -> tuple[str | None, float | None]:
        if text is None:
            return None, None
        start = time.perf_counter()
        for n in range(tries):
            if n:
                time.sleep(pause * 2 ** (n - 1))
            try:
                said = model(text)
                if fit is None or fit(said):
                    return said, time.perf_counter() - start
            except Exception:
                if strict and n == tries - 1:
                    raise
        return None, time.perf_counter() - start

    @F.pandas_udf("said string, sec double")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(at_once) as pool:
            for texts in batches:
                yield pd.DataFrame(list(pool.map(one, texts)), columns=["said", "sec"]).astype({"said": object, "sec": float})

    asked = df.withColumn("_reply", ask.asNondeterministic()(F.col(prompt))).withColumn(out, F.col("_reply.said"))
    return (asked if seconds is None else asked.withColumn(seconds, F.col("_reply.sec"))).drop("_reply")


def replied(df: DataFrame, model: Callable[[str], str], folder: str, *, prompt: str = "prompt", out: str = "answer", seconds: str = "sec", rows: int = 10_000, **options) -> DataFrame:
    """As call_model, with the replies written to a folder under their prompt's digest, in rounds of about so many prompts.

    Equal prompts are asked once. What a round has written is not asked again, whether an executor is lost, the job
    ends with an error, or it is run anew; prompts that got no answer are.
    """
    spark = df.sparkSession
    schema = "_key string, reply string, sec double"
    known = lambda: spark.read.schema(schema).parquet(folder).groupBy("_key").agg(F.min(F.struct("reply", "sec")).alias("r")) if exists(spark, folder) else spark.createDataFrame([], "_key string, r struct<reply string, sec double>")
    df = kept(df.withColumn("_key", F.sha2(F.col(prompt), 256)))
    asked = df.where(F.col(prompt).isNotNull()).groupBy("_key").agg(F.first(prompt).alias("_prompt"))
    rounds = -(-asked.join(known(), "_key", "left_anti").count() // rows)
    for i in range(rounds):
        part = asked.where(F.pmod(F.xxhash64("_key"), F.lit(rounds)) == i).join(known(), "_key", "left_anti").repartition(spark.sparkContext.defaultParallelism)
        said = call_model(part, model, prompt="_prompt", out="reply", seconds="sec", **options)
        said.where("reply is not null").select("_key", "reply", "sec").write.mode("append").parquet(folder)
    return df.join(known(), "_key", "left").withColumns({out: F.col("r.reply"), seconds: F.col("r.sec")}).drop("_key", "r")


def answers(questions: DataFrame, hits: DataFrame, model: Callable[[str], str], *, strict: bool = True, folder: str | None = None, at_once: int = 8) -> DataFrame:
    """qid, verdict, text, citations, refused, degraded, chunks_used and sec (of the model; null if it wasn't asked). The model is only asked where the evidence will do.

    folder: where its replies are kept as they come (replied()).

    A model that fails ends the job; without strict its answer is null, and nothing is cited for it.
    """
    df = prompts(questions, hits).join(triage(questions, hits).select("qid", "verdict"), "qid")
    asked = F.col("verdict").isin("ok", "degraded")
    df = df.withColumn("_ask", F.when(asked, F.col("prompt")))
    options = {"prompt": "_ask", "out": "_said", "seconds": "sec", "strict": strict, "at_once": at_once}
    df = call_model(df, model, **options) if folder is None else replied(df, model, folder, **options)
    lost = asked & F.col("_said").isNull()
    gave_up = asked & F.coalesce(refuses(F.col("_said")), F.lit(False))
    none = F.array().cast("array<string>")
    text = F.when((F.col("verdict") == "refuse_no_hit") | gave_up, REFUSAL).when(F.col("verdict") == "refuse_low_trust", LOW_TRUST).otherwise(F.col("_said"))
    return df.select(
        "qid", "verdict", text.alias("text"),
        F.when(gave_up | lost | (F.col("verdict") == "refuse_no_hit"), none).otherwise(F.col("citations")).alias("citations"),
        (~asked | gave_up).alias("refused"), (((F.col("verdict") == "degraded") & ~gave_up) | (F.col("verdict") == "refuse_low_trust")).alias("degraded"),
        F.when(asked & ~gave_up & ~lost, F.col("chunks_used")).otherwise(none).alias("chunks_used"), "sec",
    )


def judge_key(qid: Column, golden: Column, answer: Column) -> Column:
    blank = lambda c: F.coalesce(c, F.lit(""))
    return F.substring(F.sha1(F.encode(F.concat(blank(qid), F.lit("|"), blank(golden), F.lit("|"), blank(answer)), "UTF-8")), 1, 20)


def parse_verdict(raw: Column) -> Column:
    """struct(verdict, reason) of a judge's reply, in whatever it is wrapped; null without a known verdict."""
    text = F.translate(raw, "“”", '""')
    found = F.nullif(F.regexp_extract(text, '(?s)\\{[^{}]*"verdict"[^{}]*\\}', 0), F.lit(""))
    read = F.from_json(found, "verdict string, reason string")
    loose = F.nullif(F.regexp_extract(found, '"verdict"\\s*:\\s*"(correct|partial|incorrect)"', 1), F.lit(""))
    verdict = F.coalesce(read["verdict"], loose)
    reason = F.when(read["verdict"].isNotNull(), F.substring(F.coalesce(read["reason"], F.lit("")), 1, 60)).otherwise("")
    return F.when(verdict.isin("correct", "partial", "incorrect"), F.struct(verdict.alias("verdict"), reason.alias("reason")))


def _holds_verdict(reply: str) -> bool:
    return re.search(r'"verdict"\s*:\s*"(correct|partial|incorrect)"', (reply or "").replace("“", '"').replace("”", '"')) is not None


def judged(rows: DataFrame, cache: DataFrame, model: Callable[[str], str] | None, *, prompt: Callable[[Column, Column, Column], Column] = judge_prompt, tries: int = 2) -> DataFrame:
    """Verdicts on (qid, question, golden_answer, answer_text): from the cache (key, verdict, reason), the model (asked again if its reply holds no verdict), or the answer's keys.

    Returns the rows with key, verdict, reason, source (cache, llm or fallback). Only `llm` verdicts belong into the cache.
    """
    df = rows.withColumn("key", judge_key(F.col("qid"), F.col("golden_answer"), F.col("answer_text")))
    df = df.join(cache.select("key", F.col("verdict").alias("_cv"), F.col("reason").alias("_cr")), "key", "left")
    if model is not None:
        df = df.withColumn("_ask", F.when(F.col("_cv").isNull(), prompt(F.col("question"), F.col("golden_answer"), F.col("answer_text"))))
        df = call_model(df, model, prompt="_ask", out="_raw", tries=tries, fit=_holds_verdict)
    else:
        df = df.withColumn("_raw", F.lit(None).cast("string"))
    df = df.withColumn("_v", parse_verdict(F.col("_raw")))
    plain = F.when(holds_answer(F.col("golden_answer"), F.col("answer_text")), "correct").otherwise("incorrect")
    source = F.when(F.col("_cv").isNotNull(), "cache").when(F.col("_v").isNotNull(), "llm").otherwise("fallback")
    return df.select(*rows.columns, "key", F.coalesce("_cv", "_v.verdict", plain).alias("verdict"), F.coalesce("_cr", "_v.reason", F.lit(NO_JUDGE)).alias("reason"), source.alias("source"))


def remember(judged_rows: DataFrame, path: str) -> None:
    """Appends the model's own verdicts to the cache; fallbacks are judged again next time."""
    judged_rows.where("source = 'llm'").select("key", "verdict", "reason").write.mode("append").parquet(path)


def remembered(spark: SparkSession, path: str) -> DataFrame:
    """The cache, one verdict a key; an absent one is empty."""
    if not exists(spark, path):
        return spark.createDataFrame([], "key string, verdict string, reason string")
    return spark.read.parquet(path).groupBy("key").agg(F.min(F.struct("verdict", "reason")).alias("v")).select("key", "v.verdict", "v.reason")
