import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

import corpora
from lexquarry import cli
from lexquarry.operators import generation, registry
from lexquarry.plans import corpus
from lexquarry.sources import files
from lexquarry.streaming.registry import watch


def letters(texts):
    """Vectors by counts of characters."""
    return [[float(t.count(c)) for c in "美元欧买入条税征"] + [1.0] for t in texts]


@pytest.fixture
def service(monkeypatch):
    """A chat-completion service; what it was asked."""
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            asked.append(body | {"key": self.headers["Authorization"], "path": self.path})
            said = body["messages"][-1]["content"]
            if "评分" in said:  # no verdict at the first try
                first = sum(b["messages"][-1]["content"] == said for b in asked) % 2
                reply = "?" if first else '{"verdict": "correct", "reason": "同"}'
            else:
                reply = "买入价为6.5 [1]" if "美元" in said else "知识库中未找到足够依据，无法回答。"
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps({"choices": [{"message": {"content": reply}}]}).encode())

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    for name, value in (("URL", f"http://127.0.0.1:{server.server_port}/v1/"), ("MODEL", "m"), ("KEY", "secret")):
        monkeypatch.setenv(f"LEXQUARRY_LLM_{name}", value)
    yield asked
    server.shutdown()


@pytest.fixture
def folder(tmp_path):
    root, meta = tmp_path / "corpus", tmp_path / "meta"
    (root / "converted_docx").mkdir(parents=True)
    meta.mkdir()
    (root / "law [1].txt").write_text(corpora.LAW, encoding="utf-8")
    (root / "copy.txt").write_text(corpora.LAW, encoding="utf-8")
    (root / "rates_20210304.xlsx").write_bytes(corpora.sheet_file(corpora.GRID))
    (root / "new.docx").write_bytes(corpora.word_file(["关于汇率管理的通知", "2020年5月6日印发", "新的内容在此。"]))
    (root / "converted_docx" / "old.docx").write_bytes(corpora.word_file(["关于汇率管理的通知", "2019年5月6日印发", "旧的内容在此。"]))
    (root / "broken.docx").write_bytes(b"broken")
    (meta / "titles.json").write_text(json.dumps({"rates_20210304.xlsx": "汇率总表"}), encoding="utf-8")
    (meta / "dates.json").write_text(json.dumps({"new.docx": "2022-01-01"}), encoding="utf-8")
    (tmp_path / "md").mkdir()
    (tmp_path / "md" / "手册_1.md").write_text("# 总\n## 外币\n| 币 | 价 |\n| --- | --- |\n| 瑞郎 | 9.1 |\n", encoding="utf-8")
    return tmp_path


def run(capsys, *argv):
    cli.main([str(a) for a in argv])
    return capsys.readouterr().out


def test_index_search_and_reviews(spark, folder, capsys, monkeypatch):
    index = folder / "index"
    build = ("index", "--index", index, "--corpus", folder / "corpus", "--meta", folder / "meta", "--markdown", folder / "md")
    run(capsys, *build)
    log = lambda: sorted((r.line, r.file_path) for r in spark.read.json(f"{index}/registry_log").collect())
    assert [n for n, _ in log()] == [0] * 6
    records = {r.file_path: r for r in spark.read.parquet(f"{index}/registry").collect()}
    assert records["rates_20210304.xlsx"].doc_title == "汇率总表" and records["new.docx"].effective_date == "2022-01-01"
    assert (records["new.docx"].is_latest, records["converted_docx/old.docx"].is_latest) == (1, 0)
    # of equal files the first path stays
    assert records["copy.txt"].duplicate_of is None and records["law [1].txt"].duplicate_of == records["copy.txt"].doc_id
    reviews = {n: [p.read_text(encoding="utf-8") for p in (index / n).glob("*.csv")] for n in ("review_duplicates", "review_versions", "review_title_fail")}
    assert all(len(t) == 1 and t[0].startswith("\ufeff") for t in reviews.values())
    assert "law [1].txt" in reviews["review_duplicates"][0] and "converted_docx/old.docx" in reviews["review_versions"][0] and "old" in reviews["review_versions"][0]
    out = run(capsys, "search", "--index", index, "美元买入汇率是多少")
    assert out.startswith("[1]") and "汇率总表" in out.splitlines()[0]
    assert "手册" in run(capsys, "search", "--index", index, "瑞郎").splitlines()[0]
    assert "历史版本" not in run(capsys, "search", "--index", index, "旧的内容在此") and "历史版本" in run(capsys, "search", "--index", index, "旧的内容在此", "--history")

    # a second run opens what changed, and takes an ungrouped file out of its versions
    (folder / "corpus" / "law [1].txt").write_text(corpora.LAW.replace("全国", "全境内"), encoding="utf-8")
    (folder / "meta" / "ungroup.json").write_text(json.dumps(["converted_docx/old.docx"]), encoding="utf-8")
    opened = []
    plain = files.scan_tree
    monkeypatch.setattr(files, "scan_tree", lambda *a, **k: (opened.append(k.get("paths")), plain(*a, **k))[1])
    run(capsys, *build)
    assert [n for n, _ in log()] == [0] * 6 + [1] and log()[-1] == (1, "law [1].txt")
    assert [p for p in opened if p] and all(len(p) == 1 and p[0].endswith("law [1].txt") for p in opened if p)
    records = {r.file_path: r for r in spark.read.parquet(f"{index}/registry").collect()}
    assert len(records) == 6 and records["law [1].txt"].duplicate_of is None and records["converted_docx/old.docx"].is_latest == 1


def test_learned_words_and_cells(spark, folder, capsys, monkeypatch):
    index, build = folder / "index", lambda *more: ("index", "--index", folder / "index", "--corpus", folder / "corpus", "--meta", folder / "meta", *more)
    run(capsys, *build("--words", "--blocks"))
    assert files.exists(spark, f"{index}/words") and files.exists(spark, f"{index}/blocks") and "汇率总表" in run(capsys, "search", "--index", index, "美元买入汇率是多少").splitlines()[0]
    run(capsys, *build())
    assert not files.exists(spark, f"{index}/words") and not files.exists(spark, f"{index}/blocks") and "汇率总表" in run(capsys, "search", "--index", index, "美元买入汇率是多少").splitlines()[0]
    monkeypatch.setattr(cli, "embedding_from_environment", lambda: lambda texts: [[float(t.count(c)) for c in "美元欧买入条税征"] + [1.0] for t in texts])
    run(capsys, *build("--retriever", "dense", "--cells", "3"))
    search = lambda *more: run(capsys, "search", "--retriever", "dense", "--index", index, "-k", "3", *more, "美元美元买入")
    assert search() == search("--nprobe", "3") and "汇率总表" in search("--nprobe", "1").splitlines()[0]


def test_dense_index(spark, folder, capsys, monkeypatch):
    monkeypatch.setenv("LEXQUARRY_EMBED", "test_cli:letters")
    monkeypatch.setattr(cli, "embedding_from_environment", lambda: lambda texts: [[float(t.count(c)) for c in "美元欧买入条税征"] + [1.0] for t in texts])
    index = folder / "index"
    run(capsys, "index", "--retriever", "dense", "--index", index, "--corpus", folder / "corpus", "--meta", folder / "meta")
    out = run(capsys, "search", "--retriever", "dense", "--index", index, "-k", "3", "美元美元买入").splitlines()
    assert len(out) == 3 and "汇率总表" in out[0]
    assert not any("历史版本" in x for x in run(capsys, "search", "--retriever", "dense", "--index", index, "-k", "50", "通知").splitlines())
    assert any("历史版本" in x for x in run(capsys, "search", "--retriever", "dense", "--index", index, "-k", "50", "通知", "--history").splitlines())


def test_ask_eval_and_calibrate(spark, folder, capsys, service):
    index = folder / "index"
    run(capsys, "index", "--index", index, "--corpus", folder / "corpus", "--meta", folder / "meta")
    out = run(capsys, "ask", "--index", index, "美元买入汇率是多少").splitlines()
    assert out[0] == "买入价为6.5 [1]" and "汇率总表" in out[1]
    (call,) = service
    assert call["path"] == "/v1/chat/completions" and call["key"] == "Bearer secret" and (call["temperature"], call["max_tokens"], call["model"]) == (0.1, 800, "m")
    assert [m["role"] for m in call["messages"]] == ["system", "user"] and call["messages"][0]["content"] == generation.SYSTEM and "知识库中未找到足够依据,无法回答。" in generation.SYSTEM
    assert run(capsys, "ask", "--index", index, "第二条适用全国范围").splitlines() == ["知识库中未找到足够依据,无法回答。"]

    source = lambda path, title: {"doc_title": title, "file_path": path, "locator": None}
    asked = [("X1", "xlsx", "table", "美元买入汇率是多少", "6.5", source("a/rates_20210304.xlsx", "汇率总表")), ("T1", "txt", "fact", "第二条适用全国范围", "全国", source("copy.txt", "税收征管办法")), ("N1", "none", "refuse", "第三条 自何时起施行", "", None)]
    names = ("qid", "format", "qtype", "question", "golden_answer", "expected_source")
    (folder / "test.jsonl").write_text("\n".join(json.dumps(dict(zip(names, a, strict=True)), ensure_ascii=False) for a in asked) + "\n\n", encoding="utf-8")
    assert files.read_testset(spark, str(folder / "test.jsonl")).count() == 3
    out = run(capsys, "eval", "--index", index, "--testset", folder / "test.jsonl")
    assert "|  NULL|  2|     1.0|" in out
    service.clear()
    out = run(capsys, "eval", "--mode", "full", "--judge", "llm", "--index", index, "--testset", folder / "test.jsonl")
    judge = [b for b in service if "评分" in b["messages"][-1]["content"]]
    assert len(service) - len(judge) == 3 and len(judge) == 4 and all((b["temperature"], b["max_tokens"]) == (0, 120) and len(b["messages"]) == 1 for b in judge)
    detail = {r.qid: r for r in spark.read.json(f"{index}/detail").collect()}
    assert (detail["X1"].ok, detail["T1"].ok, detail["N1"].ok) == (True, False, True) and detail["T1"].refused and detail["X1"].retrieved_files[0] == "rates_20210304.xlsx"
    assert "0.667" in out
    (folder / "labels.json").write_text(json.dumps({"X1": True, "T1": False, "N1": True}))
    service.clear()
    out = run(capsys, "calibrate", "--index", index, "--detail", index / "detail", "--labels", folder / "labels.json")
    assert not service and "0.5" in out and "false" in out and "T1" in out  # all from the cache


def test_a_failing_model_ends_the_job_or_is_null(spark):
    q = spark.createDataFrame([("1", "q")], "qid string, question string")
    hits = spark.createDataFrame([("1", 1, 2.0, "A", "c", "t", "i")], "qid string, rank int, score double, citation_level string, citation string, text string, chunk_id string")

    def fails(prompt):
        raise OSError("out of order")

    with pytest.raises(Exception, match="out of order"):
        generation.answers(q, hits, fails).collect()
    lost = generation.answers(q, hits, fails, strict=False).first()
    assert lost.text is None and lost.citations == [] and lost.chunks_used == []


def test_stream_and_batch_records_are_the_same(spark, folder):
    watch(spark, str(folder / "corpus"), str(folder / "out"), str(folder / "cp")).awaitTermination(60)
    fields = [c for c in corpus.build_registry(spark, str(folder / "corpus")).columns if c != "mtime"]
    batch = corpus.build_registry(spark, f"file://{folder}/corpus").select(*fields)
    assert sorted(map(str, spark.read.parquet(str(folder / "out")).select(*fields).collect())) == sorted(map(str, batch.collect()))
    known = spark.read.parquet(str(folder / "out"))
    assert corpus.build_registry(spark, str(folder / "corpus"), known).count() == 0


def test_default_versions_and_routes(spark):
    df = spark.createDataFrame([("a",)], "doc_id string")
    assert registry.default_versions(df).first().asDict() == {"doc_id": "a", "duplicate_of": None, "is_latest": 1}
    assert [corpus.route(f) for f in ("docx", "doc_converted", "txt", "md", "xlsx")] == ["word", "word", "text", "markdown", "sheet"]
    with pytest.raises(ValueError, match="pdf"):
        corpus.route("pdf")


def test_a_title_of_many_versions(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("doc_id"), F.format_string("p%06d", "id").alias("file_path"), F.lit("一个很长的办法标题").alias("doc_title"), F.lit("OK").alias("status"), F.lit("x").alias("title_source"), F.format_string("2%03d", F.col("id") % 900).alias("effective_date"), F.lit(None).cast("string").alias("duplicate_of"))
    out = registry.mark_versions(df, ordinal="file_path")
    assert [r.file_path for r in out.where("is_latest = 1").collect()] == ["p000899"] and out.where("ambiguous").count() == 5000
