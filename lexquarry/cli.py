"""Command line: index, search, ask, eval and calibrate.

The model of answers is the chat-completion service that LEXQUARRY_LLM_URL, _MODEL and _KEY name; LEXQUARRY_JUDGE_MODEL
names another one of its models for judging. Dense retrieval takes its vectors from LEXQUARRY_EMBED, module:function,
which gets a list of texts and returns a list of vectors.
"""

from __future__ import annotations

import argparse
import json
import os
import urllib.request
from functools import partial
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexquarry.operators import blocks, bm25, dense, evaluation, generation, registry, words
from lexquarry.plans import corpus
from lexquarry.session import session
from lexquarry.sources import files
from lexquarry.types import DETAIL, RECORD


def chat(prompt: str, *, url: str, model: str, key: str, system: str = "", temperature: float = 0.1, tokens: int = 800, timeout: float = 30) -> str:
    """One call of a chat-completion service."""
    messages = [{"role": r, "content": c} for r, c in (("system", system), ("user", prompt)) if c]
    body = json.dumps({"model": model, "temperature": temperature, "max_tokens": tokens, "messages": messages}).encode()
    request = urllib.request.Request(url.rstrip("/") + "/chat/completions", data=body, headers={"Content-Type": "application/json", "Authorization": f"Bearer {key}"})
    with urllib.request.urlopen(request, timeout=timeout) as reply:
        return json.loads(reply.read())["choices"][0]["message"]["content"]


def model_from_environment():
    """The model that answers, told what it may say."""
    key = os.environ.get("LEXQUARRY_LLM_KEY")
    if not key:
        raise RuntimeError("LEXQUARRY_LLM_KEY isn't set; `search` works without a model")
    return partial(chat, url=os.environ["LEXQUARRY_LLM_URL"], model=os.environ["LEXQUARRY_LLM_MODEL"], key=key, system=generation.SYSTEM)


def judge_from_environment():
    """The model that judges, or None without a key: then the answers' keys decide."""
    key = os.environ.get("LEXQUARRY_LLM_KEY")
    return key and partial(chat, url=os.environ["LEXQUARRY_LLM_URL"], model=os.environ.get("LEXQUARRY_JUDGE_MODEL") or os.environ["LEXQUARRY_LLM_MODEL"], key=key, temperature=0, tokens=120)


def embedding_from_environment():
    module, _, name = os.environ.get("LEXQUARRY_EMBED", "").partition(":")
    if not name:
        raise RuntimeError("LEXQUARRY_EMBED isn't set to module:function, or to module:loader()")
    made = getattr(import_module(module), name.removesuffix("()"))
    return dense.Lazy(made) if name.endswith("()") else made


def _retriever(spark: SparkSession, args) -> corpus.Retriever:
    if args.retriever == "dense":
        return dense.Index.load(spark, args.index, embedding_from_environment(), nprobe=args.nprobe)
    learned = f"{args.index}/words"
    kind = blocks.Index if files.exists(spark, f"{args.index}/blocks") else bm25.Index
    return kind.load(spark, args.index, tokenizer=words.Segmenter.load(spark, learned).tokens) if files.exists(spark, learned) else kind.load(spark, args.index)


def _known(spark: SparkSession, log: str) -> tuple[DataFrame | None, int]:
    """The last record of every document in the log, and the number of the next run."""
    if not files.exists(spark, log):
        return None, 0
    lines = spark.read.schema(RECORD).json(log)
    return files.registry_log(lines), (lines.agg(F.max("line")).first()[0] or 0) + 1


def _index(spark: SparkSession, args) -> None:
    meta = lambda name: files.json_map(spark, f"{args.meta}/{name}") if args.meta else None
    log = f"{args.index}/registry_log"
    known, number = _known(spark, log)
    registry.append_log(corpus.build_registry(spark, args.corpus, known), log, number)
    ungrouped = None
    if args.meta and files.exists(spark, f"{args.meta}/ungroup.json"):
        paths = spark.read.text(f"{args.meta}/ungroup.json", wholetext=True)
        ungrouped = paths.select(F.explode(F.from_json("value", "array<string>")).alias("file_path"))
    records = corpus.finalize(_known(spark, log)[0], date_overrides=meta("dates.json"), title_overrides=meta("titles.json"), ungrouped=ungrouped)
    registry.write_reviews(records, args.index)
    records = spark.read.parquet(f"{args.index}/registry")
    registry.parse_counts(records).orderBy("format").show()
    registry.version_counts(records).show()
    markdown = files.scan_markdown(spark, *args.markdown) if args.markdown else None
    made = corpus.chunks(spark, args.corpus, records, markdown)
    made.write.mode("overwrite").parquet(f"{args.index}/made")
    made = spark.read.parquet(f"{args.index}/made")
    corpus.level_histogram(made).show()
    if args.retriever == "dense":
        dense.build(made, embedding_from_environment()).save(args.index, cells=args.cells)
        return
    learned = f"{args.index}/words"
    for old in (learned, f"{args.index}/blocks"):
        files.remove(spark, old)
    if args.words:
        words.learn(made.select(F.concat_ws("\n", "doc_title", "text").alias("text"))).save(learned)
    index = bm25.build(made, tokenizer=words.Segmenter.load(spark, learned).tokens) if args.words else bm25.build(made)
    (blocks.build(index) if args.blocks else index).save(args.index)


def _one(spark: SparkSession, args) -> DataFrame:
    return spark.createDataFrame([("q", args.question, args.history)], "qid string, question string, include_history boolean")


def _search(spark: SparkSession, args) -> None:
    hits = corpus.search(_retriever(spark, args), _one(spark, args), k=args.k)
    for row in corpus.listing(hits).orderBy("rank").toLocalIterator():
        print(row["line"])


def _ask(spark: SparkSession, args) -> None:
    question = _one(spark, args)
    answer = generation.answers(question, corpus.search(_retriever(spark, args), question, k=args.k), model_from_environment()).first()
    print(answer["text"], *answer["citations"], sep="\n")


def _judged(spark: SparkSession, rows: DataFrame, args) -> DataFrame:
    """Verdicts of the judge on (qid, question, golden_answer, answer_text), written once and remembered."""
    cache, path = f"{args.index}/judge_cache", f"{args.index}/judged"
    generation.judged(rows, generation.remembered(spark, cache), judge_from_environment()).write.mode("overwrite").parquet(path)
    done = spark.read.parquet(path)
    generation.remember(done, cache)
    return done


def _eval(spark: SparkSession, args) -> None:
    asked = files.read_testset(spark, args.testset).withColumn("include_history", F.col("qtype") == "version")
    twins = evaluation.equivalents(files.json_map(spark, args.twins, value="array<string>").select(F.col("key").alias("file"), F.explode("value").alias("same"))) if args.twins else spark.createDataFrame([], "file string, same string")
    hits = corpus.search(_retriever(spark, args), asked, k=args.k)
    if args.mode == "retrieval":
        evaluation.retrieval_metrics(asked, hits, twins).orderBy("format").show()
        return
    # replies are kept as they come, so that no question is asked twice
    if not args.resume:
        files.remove(spark, f"{args.index}/replies")
    generation.answers(asked, hits, model_from_environment(), folder=f"{args.index}/replies", at_once=args.at_once).write.mode("overwrite").parquet(f"{args.index}/answers")
    answers, key_ok = spark.read.parquet(f"{args.index}/answers"), None
    if args.judge == "llm":
        judged = _judged(spark, asked.where("qtype <> 'refuse'").join(answers, "qid").select("qid", "question", "golden_answer", F.coalesce("text", F.lit("")).alias("answer_text")), args)
        key_ok = judged.select("qid", (F.col("verdict") == "correct").alias("key_ok"))
        evaluation.judge_stats(judged).show()
    rows = evaluation.verdicts(asked, answers, hits, twins, key_ok=key_ok)
    found = hits.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "file_name"))).alias("f")).select("qid", F.transform("f", lambda x: x["file_name"]).alias("retrieved_files"))
    detail = asked.drop("notes", "include_history").join(answers.select("qid", F.col("text").alias("answer_text"), "citations", "degraded", "sec"), "qid").join(found, "qid", "left").join(rows.drop("qtype", "format"), "qid")
    evaluation.write_detail(detail, f"{args.index}/detail")
    evaluation.full_metrics(spark.read.schema(DETAIL).json(f"{args.index}/detail")).show()
    evaluation.grouped_accuracy(spark.read.schema(DETAIL).json(f"{args.index}/detail")).orderBy("by", "value").show(100)


def _calibrate(spark: SparkSession, args) -> None:
    """The judge against people: its verdicts on a full evaluation's answers and their labels."""
    detail = spark.read.schema(DETAIL).json(args.detail)
    labels = files.json_map(spark, args.labels, value="boolean").select(F.col("key").alias("qid"), F.col("value").alias("human"))
    rows = detail.where("qtype <> 'refuse'").join(labels.select("qid"), "qid", "left_semi")
    verdicts = _judged(spark, rows.select("qid", "question", "golden_answer", F.coalesce("answer_text", F.lit("")).alias("answer_text")), args).join(rows.select("qid", "qtype"), "qid")
    evaluation.calibration(verdicts, labels, threshold=args.threshold).show()
    evaluation.mismatches(verdicts, labels).show(100, truncate=False)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    commands = parser.add_subparsers(required=True)

    def command(name, run, *options):
        p = commands.add_parser(name)
        p.set_defaults(run=run)
        for flag, extra in options:
            p.add_argument(flag, **extra)

    at, by = ("--index", {"required": True}), ("--retriever", {"choices": ("bm25", "dense"), "default": "bm25"})
    k, history = ("-k", {"type": int, "default": 5}), ("--history", {"action": "store_true"})
    nprobe = ("--nprobe", {"type": int, "help": "cells of a dense index that a question opens"})
    command("index", _index, at, by, ("--blocks", {"action": "store_true", "help": "postings in blocks, of which questions open a part: for large indexes"}), ("--words", {"action": "store_true", "help": "words learned from the corpus instead of pairs of characters"}), ("--cells", {"type": int, "default": 0, "help": "cells of a dense index"}), ("--corpus", {"required": True}), ("--meta", {}), ("--markdown", {"nargs": "*"}))
    command("search", _search, at, by, nprobe, ("question", {}), k, history)
    command("ask", _ask, at, by, nprobe, ("question", {}), k, history)
    command("eval", _eval, at, by, nprobe, ("--testset", {"required": True}), ("--twins", {}), ("--mode", {"choices": ("retrieval", "full"), "default": "retrieval"}), ("--judge", {"choices": ("keys", "llm"), "default": "keys"}), ("--resume", {"action": "store_true", "help": "go on with the replies of a run that ended early"}), ("--at-once", {"type": int, "default": 8, "help": "calls of the model at a time in a task"}), k)
    command("calibrate", _calibrate, at, ("--detail", {"required": True}), ("--labels", {"required": True}), ("--threshold", {"type": float, "default": 0.95}))
    args = parser.parse_args(argv)
    args.run(session(), args)


if __name__ == "__main__":
    main()
