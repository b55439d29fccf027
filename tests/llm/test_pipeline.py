import cases
import corpus_pipeline
import pytest
from lexquarry.llm import langid
from lexquarry.llm.queries import QUERIES


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents and benchmark as the driver lays them out, with an extra column."""
    path = tmp_path_factory.mktemp("sf")
    rows = cases.texts()
    cases.documents(spark, rows).write.parquet(f"{path}/documents.parquet")
    w = cases.alnum(rows[20])
    bench = [(1, " ".join(w[:30])), (2, None), (3, "nothing of the kind")]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), rows, bench


def test_stages_match_brute_force(spark, folder, tmp_path):
    path, rows, bench = folder
    kept = {i: t for i, t in enumerate(rows)}
    docs = spark.read.parquet(f"{path}/documents.parquet")

    def step(n, docs):
        name, f = corpus_pipeline.STAGES[n]
        f(spark, docs, path).write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    docs = step(0, docs)
    assert docs.columns == list(corpus_pipeline.COLUMNS)
    got = {r.doc_id for r in docs.collect()}
    lettered = {i for i, t in kept.items() if t and any(c.isalpha() for c in t)}
    assert got == lettered
    kept = {i: kept[i] for i in sorted(got)}

    docs = step(1, docs)
    ids = list(kept)
    _, least = cases.linked([kept[i] for i in ids], 5, 80, 100)
    kept = {i: kept[i] for k, i in enumerate(ids) if least[k] == k}
    assert {r.doc_id: r.text for r in docs.collect()} == kept

    docs = step(2, docs)
    ids = list(kept)
    left = cases.cut_repeats([kept[i] for i in ids], 50)
    kept = {i: t if len(w) == len(cases.spaced(t)) else " ".join(w) for (i, t), w in zip(kept.items(), left, strict=True)}
    out = docs.collect()
    assert {r.doc_id: r.text for r in out} == kept and all(r.n_chars == len(r.text) for r in out)

    docs = step(3, docs)
    judged = cases.hits(list(kept.values()), [(str(i), t) for i, t in bench], 13)
    kept = {i: t for (i, t), (n, hit, _) in zip(kept.items(), judged, strict=True) if not (hit and 20 * hit >= n)}
    assert {r.doc_id: r.text for r in docs.collect()} == kept and docs.columns == list(corpus_pipeline.COLUMNS)

    docs = step(4, docs)
    out = {r.doc_id: r for r in docs.collect()}
    assert set(out) == set(kept)
    for i, r in out.items():
        assert r["size"] == len(cases.spaced(kept[i])) and r.taken == r.copies * r["size"] <= 3 * r["size"]
    total = sum(r["size"] for r in out.values())
    assert sum({r.source: r.target for r in out.values()}.values()) == pytest.approx(total)


def test_near_dedup_of_repeated_ids(spark):
    """One row of each group stays, whatever the ids; groups aren't joined by an id of several texts."""
    a, b, c = (" ".join(f"{k}{i}" for i in range(60)) for k in "abc")
    near = a.replace("a59", "x")
    data = [(5, a), (5, a), (5, b), (7, a), (7, c), (8, near), (8, near), (9, b), (9, "other words entirely"), (4, c), (None, a), (None, a), (6, "..."), (6, ""), (6, ""), (6, None)]
    df = spark.createDataFrame([(i, t, "en", f"s{k}", None if t is None else len(t)) for k, (i, t) in enumerate(data)], "doc_id long, text string, lang string, source string, n_chars long")
    want = [(5, a), (5, b), (4, c), (9, "other words entirely"), (None, a), (None, a), (6, "..."), (6, ""), (6, ""), (6, None)]
    for rows in (df.repartition(4), df.coalesce(1)):
        out = corpus_pipeline.drop_near_duplicates(spark, rows, "").collect()
        assert sorted(((r.doc_id, r.text) for r in out), key=repr) == sorted(want, key=repr)
        assert {r.source for r in out if (r.doc_id, r.text) == (5, a)} == {"s0"}


def test_whole_pipeline_runs_at_once(spark, folder):
    assert corpus_pipeline.run(spark, folder[0]).count() > 50


def test_each_document_is_told_its_language_once(spark, folder, monkeypatch):
    seen, plain = spark.sparkContext.accumulator(0), langid._predicted

    def counted(model, margin):
        body = plain(model, margin)

        def run(batches):
            for batch in body(batches):
                seen.add(batch.num_rows)
                yield batch

        return run

    monkeypatch.setattr(langid, "_predicted", counted)
    corpus_pipeline.run(spark, folder[0]).write.format("noop").mode("overwrite").save()
    assert seen.value == len(folder[1])


def test_pipeline_of_empty_tables_and_null_ids(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    text = " ".join(f"word{i}" for i in range(80))
    tables = {
        "none": ([], [(1, text)]),
        "nulls": ([(None, text, "en", None, 1), (None, text, None, "s", None), (None, None, None, None, None), (3, text, "en", "s", 5), (4, text + " end", "en", "s", 5), (5, "une autre phrase", "fr", None, 3), (5, "noch ein Satz", "de", "t", 3)], []),
    }
    for name, (rows, bench) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/none")
    assert out.count() == 0 and out.columns[:5] == list(corpus_pipeline.COLUMNS)
    out = corpus_pipeline.run(spark, f"{tmp_path}/nulls").collect()
    assert sorted((str(r.doc_id), r.text) for r in out) == sorted([("None", text), ("None", text), ("3", text), ("5", "une autre phrase"), ("5", "noch ein Satz")])


def test_every_operator_has_one_query():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))
