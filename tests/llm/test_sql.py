import cases
import duckdb
import pytest
from lexquarry.llm.queries import QUERIES
from lexquarry.llm.sql import ORACLES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_agrees_on_awkward_rows(spark, tmp_path, name):
    cases.documents(spark).write.parquet(f"{tmp_path}/documents.parquet")
    w = cases.alnum(cases.texts()[0])
    bench = [(1, " ".join(w[:30])), (12, " ".join(w[20:50])), (2, None), (3, ""), (4, "one"), (5, "x x x")]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    urls = [None, "", "a://EXAMPLE.com/en/71?x", "http://b.net/de/8", "http://example.net/de/81/#", "x://org/es/y", "x://example.com/en/", "no", "q?u=http://com/en/"]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    talks = [(c, t, None if c == 3 else "user", "é" * (t % 3) if t % 4 else None) for c in (0, 1, 2, 3, 5, 7, 11, -3, 16, 17) for t in range(c % 7 + 1)] + [(7, None, "user", "first"), (5, 1, "user", "tie"), (5, 1, "tool", "tie"), (None, 0, "user", "x"), (16, 9, "user", "again"), (16, 9, "user", "again")]
    spark.createDataFrame(talks, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    got = QUERIES[name](spark, str(tmp_path))
    want = con.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    key = lambda r: repr(r)
    assert sorted(map(tuple, got.select(*columns).collect()), key=key) == sorted(want.fetchall(), key=key)
