"""The registry as state: after every batch it is what a batch job over the whole log gives."""

import json
import random

from lexquarry.operators import registry
from lexquarry.sources import files
from lexquarry.streaming.registry import GONE, current, follow, removed
from lexquarry.types import RECORD

NAMES = [f.split()[0] for f in RECORD.split(", ")]


def record(rng, i, line):
    n = rng.randint(0, 9)
    title = rng.choice([f"关于第{n}号事项的管理办法", f"关于第{n}号事项的管理办法(2019修订)", "短", None])
    path = f"dir/{i}.txt"
    return dict(zip(NAMES, (f"id{i}", path, rng.choice(["txt", "docx"]), rng.randint(1, 3), float(line), f"h{n}", f"v{n}", rng.choice([f"f{n}", f"g{i % 4}", None]), title, rng.choice(["first_para", "FAIL"]) if rng.random() < 0.2 else "first_para", rng.choice(["2019-01-01", "2020-05", None]), None, None, rng.choice(["OK", "OK", "OK", "ERROR: bad"]), line), strict=True))


def state(records):
    marked = registry.mark_versions(registry.mark_duplicates(records, ordinal="file_path"), ordinal="file_path")
    return {r.doc_id: (r.duplicate_of, r.version_group, r.is_latest) for r in marked.collect()}


def test_three_batches_give_what_one_job_gives(spark, tmp_path):
    rng = random.Random(9)
    log, target = tmp_path / "log", str(tmp_path / "out")
    log.mkdir()
    seen, lines = {}, []
    for batch in range(3):
        new = [record(rng, rng.randint(0, 39), 100 * batch + j) for j in range(30)]
        if batch:
            again = dict(seen[sorted(seen)[0]], line=100 * batch + 50, mtime=9.9)  # the same record once more
            gone = [dict(seen[i], status=GONE, line=100 * batch + 60 + j) for j, i in enumerate(sorted(seen)[1:6])]
            new = [r for r in new if r["doc_id"] not in {again["doc_id"], *(g["doc_id"] for g in gone)}] + [again, *gone]
        lines += new
        seen |= {r["doc_id"]: r for r in new}
        (log / f"part-{batch}.json").write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in new), encoding="utf-8")
        before = {r.doc_id: r for r in current(spark, target).collect()}
        follow(spark, str(log), target, str(tmp_path / "checkpoint")).awaitTermination(120)
        every = spark.createDataFrame([tuple(r[n] for n in NAMES) for r in lines], RECORD)
        last = files.registry_log(every).where(f"status <> '{GONE}'").drop("line")
        now = current(spark, target)
        assert sorted(map(str, now.select(*last.columns).collect())) == sorted(map(str, last.collect())), batch
        changes = {r.doc_id: r.change for r in spark.read.parquet(f"{target}/changes").where(f"batch = {batch}").collect()}
        there = {r.doc_id for r in now.collect()}
        assert {d for d, c in changes.items() if c == "added"} == there - set(before) and {d for d, c in changes.items() if c == "deleted"} == set(before) - there
        if batch:
            assert changes[again["doc_id"]] == "seen" or again["doc_id"] not in before
        # versions: the last row that a document got is what it is
        rows = spark.read.parquet(f"{target}/versions").collect()
        told = {r.doc_id: (r.duplicate_of, r.version_group, r.is_latest) for r in sorted(rows, key=lambda r: r.batch)}
        assert {d: v for d, v in told.items() if d in there} == state(now), batch


def test_removed_files_are_told(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x", encoding="utf-8")
    known = spark.createDataFrame([("1", "a.txt", "OK"), ("2", "b.txt", "OK"), ("3", "c.txt", GONE)], "doc_id string, file_path string, status string")
    assert [(r.doc_id, r.status) for r in removed(spark, str(tmp_path), known).collect()] == [("2", GONE)]
