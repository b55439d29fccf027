"""Queries over the driver's tables, each beside the SQL that gives the same rows.

The tables hold no Chinese text, so rules for it run on text composed from orders and parts in the same way on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexquarry.functions import citations, dates
from lexquarry.functions import text as T
from lexquarry.operators import blocks, bm25, chunking, dense, evaluation, generation, ivf, registry, structure, words
from lexquarry.plans import composed
from lexquarry.session import spread
from lexquarry.sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- retrieval ----

_TOKENS = r"regexp_extract_all(regexp_replace({0}, '\s+', '', 'g'), '([A-Za-z0-9〔〕\[\]第条章节%．.-]+)')"
#: chunks c(chunk_ix, doc_id, is_latest, is_row, t, tt) and questions q(qid, hist, t) become scored s(qid, chunk_ix, score, first_at).
_SCORES = """
l AS (SELECT *, len(t) + 3 * len(tt) AS dl FROM c),
st AS (SELECT count(*)::DOUBLE AS n, coalesce(avg(dl), 1.0) AS a FROM l),
qt AS (SELECT qid, term, count(*) AS qtf, min(pos) AS first_at FROM (SELECT qid, unnest(t) AS term, unnest(range(len(t))) AS pos FROM q) GROUP BY 1, 2),
p AS (SELECT chunk_ix, term, sum(w)::BIGINT AS tf FROM (SELECT chunk_ix, unnest(t) AS term, 1 AS w FROM l UNION ALL SELECT chunk_ix, unnest(tt), 3 FROM l) WHERE term IN (SELECT term FROM qt) GROUP BY 1, 2),
f AS (SELECT term, count(*)::DOUBLE AS df FROM p GROUP BY 1),
s AS (SELECT qid, p.chunk_ix, min(first_at) AS first_at, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.6e0 / (tf + 1.6e0 * (0.25e0 + 0.75e0 * dl / a))), 6) AS score
      FROM p JOIN f USING (term) JOIN qt USING (term) JOIN l USING (chunk_ix), st GROUP BY 1, 2),
r AS (SELECT s.*, c.doc_id, c.is_row, row_number() OVER (PARTITION BY s.qid ORDER BY score DESC, first_at, chunk_ix) AS rank FROM s JOIN c USING (chunk_ix) JOIN q USING (qid) WHERE q.hist OR c.is_latest <> 0)
"""
_DOC_CHUNKS = f"c AS (SELECT doc_id AS chunk_ix, doc_id::VARCHAR AS doc_id, {{latest}} AS is_latest, false AS is_row, {_TOKENS.format('text')} AS t, {_TOKENS.format('concat(lang, source)')} AS tt FROM documents)"
_QUESTIONS = f"q AS (SELECT item_id AS qid, {{hist}} AS hist, {_TOKENS.format('text')} AS t FROM benchmark)"


def _document_chunks(spark: SparkSession, sf_dir: str, latest=None) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("chunk_ix"), F.col("doc_id").cast("string").alias("doc_id"), F.concat("lang", "source").alias("doc_title"), "text", (latest if latest is not None else F.lit(1)).alias("is_latest"))


def _questions(spark: SparkSession, sf_dir: str, hist=None) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("qid"), F.col("text").alias("question"), (hist if hist is not None else F.lit(False)).alias("include_history"))


@query(f"WITH {_DOC_CHUNKS.format(latest=1)}, {_QUESTIONS.format(hist='false')}, {_SCORES} SELECT qid, rank::INTEGER AS rank, chunk_ix, score FROM r WHERE rank <= 5")
def bm25_topk(spark, sf_dir):
    """Top five documents for each benchmark text."""
    return bm25.retrieve(bm25.build(_document_chunks(spark, sf_dir)), _questions(spark, sf_dir)).select("qid", "rank", "chunk_ix", "score")


@query(f"WITH {_DOC_CHUNKS.format(latest='CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 1 END')}, {_QUESTIONS.format(hist='item_id % 2 = 0')}, {_SCORES} SELECT qid, rank::INTEGER AS rank, chunk_ix, score FROM r WHERE rank <= 5")
def bm25_history_filter(spark, sf_dir):
    """A third of the documents are superseded; every other question may see them. Statistics cover them all."""
    chunks = _document_chunks(spark, sf_dir, F.when(F.col("doc_id") % 3 == 0, 0).otherwise(1))
    return bm25.retrieve(bm25.build(chunks), _questions(spark, sf_dir, F.col("item_id") % 2 == 0)).select("qid", "rank", "chunk_ix", "score")


def _line_chunks(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    row = F.when(F.contains("text", F.lit("|")) | (F.length("text") % 3 == 0), F.concat(F.lit("r"), F.col("pos").cast("string")))
    return lines.select((F.col("doc_id") * 100000 + F.col("pos")).alias("chunk_ix"), F.col("doc_id").cast("string").alias("doc_id"), F.lit("").alias("doc_title"), "text", F.lit(1).alias("is_latest"), row.alias("row_range"))


@query(f"""
WITH x AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
c AS (SELECT doc_id * 100000 + pos AS chunk_ix, doc_id::VARCHAR AS doc_id, 1 AS is_latest, (contains(text, '|') OR length(text) % 3 = 0) AS is_row, {_TOKENS.format('text')} AS t, []::VARCHAR[] AS tt FROM x),
{_QUESTIONS.format(hist='false')}, {_SCORES},
k AS (SELECT * FROM r WHERE rank <= 5),
low AS (SELECT qid, doc_id, min_by(rank, [score, rank::DOUBLE]) AS rank FROM k GROUP BY 1, 2 HAVING NOT bool_or(is_row)),
big AS (SELECT doc_id FROM c WHERE is_row GROUP BY 1 HAVING count(*) >= 3),
b AS (SELECT qid, low.rank, r.chunk_ix, r.score, row_number() OVER (PARTITION BY qid, doc_id ORDER BY r.score DESC, r.first_at, r.chunk_ix) AS n FROM low JOIN big USING (doc_id) JOIN r USING (qid, doc_id) WHERE r.is_row),
z AS (SELECT k.qid, k.rank, coalesce(b.chunk_ix, k.chunk_ix) AS chunk_ix, coalesce(b.score, k.score) AS score FROM k LEFT JOIN b ON b.qid = k.qid AND b.rank = k.rank AND b.n = 1)
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, rank)::INTEGER AS rank, chunk_ix, score FROM z
""")
def bm25_drilldown(spark, sf_dir):
    """Lines as chunks, some of them table rows; a document hit without a row has its best row taken in."""
    return bm25.retrieve(bm25.build(_line_chunks(spark, sf_dir)), _questions(spark, sf_dir)).select("qid", "rank", "chunk_ix", "score")


@query(ORACLES["bm25_history_filter"])
def bm25_blocks_topk(spark, sf_dir):
    """The same rows as bm25_history_filter, from blocks of postings of which only those that can matter are opened."""
    chunks = _document_chunks(spark, sf_dir, F.when(F.col("doc_id") % 3 == 0, 0).otherwise(1))
    return blocks.build(bm25.build(chunks)).kept().retrieve(_questions(spark, sf_dir, F.col("item_id") % 2 == 0)).select("qid", "rank", "chunk_ix", "score")


@query(ORACLES["bm25_drilldown"])
def bm25_blocks_drilldown(spark, sf_dir):
    """The same rows as bm25_drilldown, by blocks."""
    return blocks.build(bm25.build(_line_chunks(spark, sf_dir))).kept().retrieve(_questions(spark, sf_dir)).select("qid", "rank", "chunk_ix", "score")


@query(f"WITH t AS (SELECT doc_id, {_TOKENS.format('text')} AS t FROM documents) SELECT doc_id, len(t)::INTEGER AS n_tokens, list_distinct(t).len()::INTEGER AS n_distinct, coalesce(t[1], '') AS first_token FROM t")
def tokenize_marks(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select("doc_id", T.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"), F.coalesce(F.get("t", F.lit(0)), F.lit("")).alias("first_token"))


_HAN = "translate({0}, '0123456789', '零一二三四五六七八九')"


def _han(c):
    return F.translate(c, "0123456789", "零一二三四五六七八九")


@query(f"""
WITH h AS (SELECT o_orderkey, {_HAN.format('o_orderkey::VARCHAR')} AS a, {_HAN.format('o_custkey::VARCHAR')} AS b FROM orders)
SELECT o_orderkey, concat('第', '|', array_to_string(list_transform(range(1, length(a || '第' || b)), lambda i: substr(a || '第' || b, i, 2)), '|')) AS toks FROM h
""")
def tokenize_han(spark, sf_dir):
    """Marks first, then pairs of Han characters across what lies between them."""
    o = table(spark, sf_dir, "orders")
    text = F.concat(_han(F.col("o_orderkey").cast("string")), F.lit("，　第 "), _han(F.col("o_custkey").cast("string")))
    return o.select("o_orderkey", F.array_join(T.tokens(text), "|").alias("toks"))


#: Composed Han text: one word of each list, by orders, with a number and marks between.
_WORDS = (("纳税人", "税务机关", "企业", "个人", "扣缴义务人"), ("应当", "可以", "不得"), ("缴纳", "申报", "退还", "追征"), ("增值税", "企业所得税", "消费税", "税款", "滞纳金", "税"))
_HAN_SQL = " || ".join(f"[{', '.join(repr(w) for w in ws)}][(o_orderkey // {7 ** i} % {len(ws)} + 1)::INTEGER]" for i, ws in enumerate(_WORDS))
#: Grams with their company, and the dictionary v(word, n, cost), of texts t(o_orderkey, text).
_DICTIONARY = f"""t AS MATERIALIZED (SELECT o_orderkey, concat({_HAN_SQL}, CASE WHEN o_orderkey % 3 = 0 THEN '，' ELSE '' END, translate((o_custkey % 100)::VARCHAR, '0123456789', '零一二三四五六七八九'), '日内', ' 2.5% ', CASE WHEN o_orderkey % 4 = 0 THEN 'VAT-1 办理' ELSE '龘。' END) AS text FROM orders),
u AS (SELECT unnest(regexp_extract_all(text, '[一-鿿]+')) AS run FROM t),
e AS (SELECT run, pos, unnest(range(1, least(4, length(run) - pos + 1) + 1)) AS size FROM (SELECT run, unnest(range(1, length(run) + 1)) AS pos FROM u)),
w AS (SELECT substr(run, pos, size) AS word, size, CASE WHEN pos > 1 THEN substr(run, pos - 1, 1) ELSE '' END AS before, substr(run, pos + size, 1) AS after FROM e),
n AS MATERIALIZED (SELECT word, size, count(*) AS n FROM w GROUP BY 1, 2),
hb AS (SELECT word, ln(sum(c)) - sum(c * ln(c)) / sum(c) AS h FROM (SELECT word, before, count(*) AS c FROM w WHERE size > 1 GROUP BY 1, 2) GROUP BY 1),
ha AS (SELECT word, ln(sum(c)) - sum(c * ln(c)) / sum(c) AS h FROM (SELECT word, after, count(*) AS c FROM w WHERE size > 1 GROUP BY 1, 2) GROUP BY 1),
z AS (SELECT word, n, unnest(range(1, size)) AS cut FROM n WHERE size > 1 AND n >= 5),
c AS (SELECT z.word, min(z.n * (SELECT sum(n) FROM n WHERE size = 1)::DOUBLE / (a.n * b.n)) AS cohesion FROM z JOIN n a ON a.word = substr(z.word, 1, cut) JOIN n b ON b.word = substr(z.word, cut + 1) GROUP BY 1),
d AS (SELECT word, n FROM n JOIN c USING (word) JOIN hb USING (word) JOIN ha USING (word) WHERE round(cohesion, 6) >= 8 AND round(least(hb.h, ha.h), 6) >= 0.5 UNION ALL SELECT word, n FROM n WHERE size = 1),
v AS MATERIALIZED (SELECT word, n, round(1000000 * ln((SELECT sum(n) FROM d)::DOUBLE / n))::BIGINT AS cost FROM d)"""


def _han_text(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    word = lambda i, ws: F.element_at(F.array(*(F.lit(w) for w in ws)), (F.floor(key / 7**i) % len(ws) + 1).cast("int"))
    text = F.concat(*(word(i, ws) for i, ws in enumerate(_WORDS)), F.when(key % 3 == 0, "，").otherwise(""), _han((F.col("o_custkey") % 100).cast("string")), F.lit("日内 2.5% "), F.when(key % 4 == 0, "VAT-1 办理").otherwise("龘。"))
    return o.select("o_orderkey", text.alias("text"))


@query(f"WITH {_DICTIONARY} SELECT word, n, cost FROM v")
def word_dictionary(spark, sf_dir):
    """Words that hold together and stand in varied company, counted from composed Han text."""
    return words.dictionary(_han_text(spark, sf_dir))


@query(f"""WITH RECURSIVE {_DICTIONARY}, m AS (SELECT map(list(word), list(cost)) AS m FROM v),
q AS (SELECT o_orderkey, i, p, p[1:1] BETWEEN '一' AND '鿿' AS han FROM (SELECT o_orderkey, unnest(ps) AS p, unnest(range(len(ps))) AS i FROM (SELECT o_orderkey, regexp_extract_all(text, '[一-鿿]+|[A-Za-z0-9]+(?:[.%％-][A-Za-z0-9]+)*[%％]?|[^\\s]') AS ps FROM t))),
y AS (SELECT DISTINCT p FROM q WHERE han),
r AS (SELECT p, length(p) AS pos, [0::BIGINT] AS costs, [''] AS paths FROM y UNION ALL
  SELECT p, pos - 1, list_prepend(b.x, costs), list_prepend(b.y, paths) FROM (SELECT p, pos, costs, paths, list_min(list_transform(list_filter(range(1, least(4, length(p) - pos + 1) + 1), lambda k: m[substr(p, pos, k)] IS NOT NULL), lambda k: {{'x': m[substr(p, pos, k)] + costs[k], 'z': -k, 'y': substr(p, pos, k) || CASE WHEN paths[k] = '' THEN '' ELSE '|' || paths[k] END}})) AS b FROM r, m WHERE pos > 0))
SELECT o_orderkey, string_agg(coalesce(f.path, q.p), '|' ORDER BY i) AS tokens FROM q LEFT JOIN (SELECT p, paths[1] AS path FROM r WHERE pos = 0) f ON han AND f.p = q.p GROUP BY 1""")
def word_segmentation(spark, sf_dir):
    """Texts along the cheapest path of words of that dictionary."""
    t = _han_text(spark, sf_dir)
    return words.learn(t).segment(t, key="o_orderkey").select("o_orderkey", F.array_join("tokens", "|").alias("tokens"))


@query(f"WITH t AS (SELECT len({_TOKENS.format('text')}) + 3 * len({_TOKENS.format('concat(lang, source)')}) AS dl FROM documents) SELECT count(*) AS n, round(coalesce(avg(dl), 1.0), 6) AS avgdl, sum(dl)::BIGINT AS total FROM t")
def index_stats(spark, sf_dir):
    index = bm25.build(_document_chunks(spark, sf_dir))
    return index.chunks.agg(F.sum("dl").alias("total")).join(F.broadcast(index.stats), F.lit(True)).select(F.col("N").alias("n"), F.round("avgdl", 6).alias("avgdl"), "total")


@query(f"WITH t AS (SELECT doc_id, unnest({_TOKENS.format('text')}) AS term FROM documents UNION SELECT doc_id, unnest({_TOKENS.format('concat(lang, source)')}) FROM documents) SELECT term, count(*) AS df FROM t GROUP BY 1")
def doc_freq(spark, sf_dir):
    return bm25.build(_document_chunks(spark, sf_dir)).doc_freq()


_COSINE = "WITH q AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT qid, vec_id, round(list_cosine_similarity(e, embedding::DOUBLE[]), 6) AS score FROM q, embeddings WHERE {0}) SELECT qid, vec_id, score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"


def _vectors(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return v.withColumn("is_latest", F.when(F.col("label") % 2 == 0, 1).otherwise(0)), v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding")


@query(_COSINE.format("true"))
def dense_topk_cosine(spark, sf_dir):
    return dense.top_k(*_vectors(spark, sf_dir))


@query(_COSINE.format("label % 2 = 0"))
def dense_filtered(spark, sf_dir):
    """History leaves before the ranking, unlike in BM25."""
    return dense.top_k(*_vectors(spark, sf_dir), latest_only=True)


@query(_COSINE.format("true"))
def dense_ivf_all_cells(spark, sf_dir):
    """The inverted file with every cell open gives the exact answer."""
    v, asked = _vectors(spark, sf_dir)
    index = ivf.build(v)
    return index.top_k(asked, nprobe=len(index.centres))


@query()
def dense_ivf_topk(spark, sf_dir):
    """The inverted file, each question opening half of the cells: these vectors have hardly any clusters, so fewer would not do (tests/test_ivf.py has the recall)."""
    v, asked = _vectors(spark, sf_dir)
    index = ivf.build(v)
    return index.top_k(asked, nprobe=-(-len(index.centres) // 2))


@query("WITH a AS (SELECT vec_id, label, 0 AS batch FROM embeddings UNION ALL SELECT vec_id + 7, label + 100, 1 FROM embeddings WHERE vec_id % 5 = 0) SELECT vec_id, max_by(label, batch) AS label, max(batch)::INTEGER AS batch FROM a GROUP BY 1")
def dense_upsert(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.lit(0).alias("batch"))
    more = v.where("vec_id % 5 = 0").select((F.col("vec_id") + 7).alias("vec_id"), (F.col("label") + 100).alias("label"), F.lit(1).alias("batch"))
    return dense.upsert(v, more)


@query("SELECT vec_id, label FROM embeddings WHERE label NOT IN (SELECT label FROM embeddings WHERE vec_id < 3)")
def dense_delete(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    return dense.delete(v, v.where("vec_id < 3"), key="label").select("vec_id", "label")


# ---- registry ----

_REGISTRY = r"""reg AS (SELECT substr(sha1(p), 1, 16) AS doc_id, p AS file_path, ['docx', 'doc_converted', 'txt', 'xlsx', 'md'][1 + doc_id % 5] AS format, n_chars AS size, doc_id AS line,
CASE WHEN regexp_replace(text, '\s+', '', 'g') <> '' THEN substr(sha1(regexp_replace(text, '\s+', '', 'g')), 1, 16) END AS fingerprint,
CASE WHEN doc_id % 17 = 0 THEN 'FAIL' ELSE 'first_para' END AS title_source, concat('《', source, ' ', lang, ' rules of ', doc_id % 9, '》(', 2000 + doc_id % 5, '修订)') AS doc_title,
CASE WHEN doc_id % 7 <> 0 THEN concat(2000 + doc_id % 20, '-', lpad((1 + doc_id % 12)::VARCHAR, 2, '0')) END AS effective_date, CASE WHEN doc_id % 41 = 0 THEN 'ERROR: bad' ELSE 'OK' END AS status
FROM (SELECT *, concat(source, '/', lang, '/', doc_id, '.txt') AS p FROM documents))"""
_PRIORITY = "coalesce(list_position(['docx', 'doc_converted', 'txt', 'xlsx'], format) - 1, 9)"
_DUPLICATES = f"dup AS (SELECT *, CASE WHEN fingerprint IS NOT NULL AND first_value(doc_id) OVER w <> doc_id THEN first_value(doc_id) OVER w END AS duplicate_of FROM reg WINDOW w AS (PARTITION BY fingerprint ORDER BY CASE format WHEN 'docx' THEN 0 WHEN 'doc_converted' THEN 1 WHEN 'txt' THEN 2 WHEN 'xlsx' THEN 3 ELSE 9 END, size DESC, line))"
_VERSIONS = r"""vt AS (SELECT *, CASE WHEN duplicate_of IS NULL AND status NOT LIKE 'ERROR%' AND title_source <> 'FAIL' AND line % 50 <> 3 THEN regexp_replace(regexp_replace(doc_title, '[《》\s]', '', 'g'), '[(（]\d{4}.*?[修订正].*?[)）]$', '') END AS t FROM dup),
vw AS (SELECT *, count(*) OVER (PARTITION BY t) AS n, row_number() OVER w AS r, first_value(effective_date) OVER w AS top, lead(effective_date) OVER w AS nxt FROM vt WINDOW w AS (PARTITION BY t ORDER BY coalesce(effective_date, '0000') DESC, line)),
amb AS (SELECT t, max(CASE WHEN r = 1 AND (top IS NULL OR top IS NOT DISTINCT FROM nxt) THEN 1 ELSE 0 END) = 1 AS amb FROM vw WHERE t IS NOT NULL AND n > 1 GROUP BY 1),
ver AS (SELECT vw.* EXCLUDE (n, r, top, nxt), CASE WHEN vw.t IS NOT NULL AND n > 1 THEN vw.t END AS version_group, (CASE WHEN vw.t IS NULL THEN CASE WHEN duplicate_of IS NULL THEN 1 END WHEN n = 1 OR r = 1 THEN 1 ELSE 0 END)::INTEGER AS is_latest, amb.amb AS ambiguous FROM vw LEFT JOIN amb ON vw.t = amb.t AND n > 1)"""


def _registry(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    n = F.col("doc_id")
    path = F.concat("source", F.lit("/"), "lang", F.lit("/"), n.cast("string"), F.lit(".txt"))
    return d.select(
        registry.doc_id(path).alias("doc_id"), path.alias("file_path"), F.element_at(F.array(*(F.lit(f) for f in ("docx", "doc_converted", "txt", "xlsx", "md"))), (1 + n % 5).cast("int")).alias("format"),
        F.col("n_chars").alias("size"), n.alias("line"), T.fingerprint(F.col("text")).alias("fingerprint"), F.when(n % 17 == 0, "FAIL").otherwise("first_para").alias("title_source"),
        F.concat(F.lit("《"), "source", F.lit(" "), "lang", F.lit(" rules of "), (n % 9).cast("string"), F.lit("》("), (2000 + n % 5).cast("string"), F.lit("修订)")).alias("doc_title"),
        F.when(n % 7 != 0, F.concat((2000 + n % 20).cast("string"), F.lit("-"), F.lpad((1 + n % 12).cast("string"), 2, "0"))).alias("effective_date"),
        F.when(n % 41 == 0, "ERROR: bad").otherwise("OK").alias("status"),
    )


def _versions(spark, sf_dir):
    r = registry.mark_duplicates(_registry(spark, sf_dir))
    return registry.mark_versions(r, r.where("line % 50 = 3").select("file_path"))


@query(f"WITH {_REGISTRY}, {_DUPLICATES} SELECT doc_id, format, fingerprint, duplicate_of FROM dup")
def registry_fingerprint_dedup(spark, sf_dir):
    return registry.mark_duplicates(_registry(spark, sf_dir)).select("doc_id", "format", "fingerprint", "duplicate_of")


@query(f"WITH {_REGISTRY}, {_DUPLICATES}, {_VERSIONS} SELECT doc_id, version_group, is_latest FROM ver")
def version_latest(spark, sf_dir):
    return _versions(spark, sf_dir).select("doc_id", "version_group", "is_latest")


@query(f"WITH {_REGISTRY}, {_DUPLICATES}, {_VERSIONS} SELECT doc_id, ambiguous FROM ver WHERE version_group IS NOT NULL")
def version_ambiguous(spark, sf_dir):
    return _versions(spark, sf_dir).where("version_group is not null").select("doc_id", "ambiguous")


@query(f"WITH {_REGISTRY}, {_DUPLICATES}, {_VERSIONS} SELECT count(*) AS n, count(duplicate_of) AS duplicates, count(DISTINCT version_group) AS version_groups, count(DISTINCT CASE WHEN ambiguous THEN version_group END) AS ambiguous_groups, count(*) FILTER (title_source = 'FAIL') AS title_fails FROM ver")
def version_counts(spark, sf_dir):
    return registry.version_counts(_versions(spark, sf_dir))


@query(f"WITH {_REGISTRY}, {_DUPLICATES}, {_VERSIONS} SELECT title_source, count(*) AS n, count(effective_date) AS dated, count(*) FILTER (duplicate_of IS NULL) AS indexable, count(*) FILTER (duplicate_of IS NULL AND is_latest = 1) AS latest FROM ver GROUP BY 1")
def doc_stats(spark, sf_dir):
    return registry.summary(_versions(spark, sf_dir))


@query(f"WITH {_REGISTRY}, {_DUPLICATES} SELECT doc_id, format FROM dup WHERE duplicate_of IS NULL AND status NOT LIKE 'ERROR%'")
def registry_indexable(spark, sf_dir):
    return registry.indexable(registry.mark_duplicates(_registry(spark, sf_dir))).select("doc_id", "format")


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value, min(event_id) AS line FROM events GROUP BY 1")
def registry_last_write_wins(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "value", F.col("event_id").alias("line"))
    return files.registry_log(e, key="user_id").select("user_id", "event_type", "value", "line")


@query("WITH f AS (SELECT o_orderkey::VARCHAR AS file_path, o_custkey AS size, o_totalprice AS mtime FROM orders) SELECT file_path FROM f WHERE file_path NOT IN (SELECT o_orderkey::VARCHAR FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0)")
def registry_incremental(spark, sf_dir):
    """New files, and files whose size changed since."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("file_path"), F.col("o_custkey").alias("size"), F.col("o_totalprice").alias("mtime"), "o_orderkey")
    known = o.where("o_orderkey % 3 <> 0").withColumn("size", F.col("size") + F.when(F.col("o_orderkey") % 5 == 0, 1).otherwise(0))
    return registry.changed_files(o, known).select("file_path")


@query(f"""WITH {_REGISTRY} SELECT doc_id,
CASE WHEN line % 4 = 0 THEN 'manual title' ELSE doc_title END AS doc_title, CASE WHEN line % 4 = 0 THEN 'manual' ELSE title_source END AS title_source,
CASE WHEN line % 3 = 0 THEN '2001-01' ELSE effective_date END AS effective_date, CASE WHEN line % 3 = 0 AND effective_date IS DISTINCT FROM '2001-01' THEN 'manual' END AS date_source FROM reg""")
def override_layer(spark, sf_dir):
    r = _registry(spark, sf_dir)
    manual = lambda n, value: r.where(F.col("line") % n == 0).select(F.col("file_path").alias("key"), F.lit(value).alias("value"))
    back = r.withColumn("file_path", F.translate("file_path", "/", "\\"))
    return registry.apply_overrides(back, manual(3, "2001-01"), manual(4, "manual title")).select("doc_id", "doc_title", "title_source", "effective_date", "date_source")


# ---- dates, titles, numerals ----

_DATES = """d AS (SELECT o_orderkey, o_orderdate AS a, o_orderdate + INTERVAL 40 DAY AS b, o_orderkey % 4 AS k FROM orders)"""


@query(rf"""WITH {_DATES} SELECT o_orderkey, CASE WHEN k = 0 THEN strftime(a, '%Y-%m-%d') WHEN k = 1 THEN strftime(greatest(a, b), '%Y-%m-%d') WHEN k = 2 THEN strftime(b, '%Y-%m-%d') END AS effective_date FROM d""")
def eff_date_extract(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    a, b = F.col("o_orderdate"), F.expr("o_orderdate + interval 40 day")
    day = lambda d: F.concat(F.year(d).cast("string"), F.lit("年"), F.month(d).cast("string"), F.lit("月"), F.day(d).cast("string"), F.lit("日"))
    k = F.col("o_orderkey") % 4
    lines = (
        F.when(k == 0, F.array(F.concat(day(a), F.lit("全国人民代表大会通过")), F.concat(day(b), F.lit("公布"))))
        .when(k == 1, F.array(F.concat(day(b), F.lit("第二次修正　"), day(a), F.lit("修订")), F.concat(day(b), F.lit("施行"))))
        .when(k == 2, F.array(F.concat(day(a), F.lit("，印发")), F.concat(F.lit("自"), day(b), F.lit("起施行"))))
        .otherwise(F.array(F.concat(day(a), F.lit("签订"))))
    )
    return o.select("o_orderkey", dates.effective_date(lines).alias("effective_date"))


@query(r"""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') WHEN 2 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS d FROM orders""")
def file_name_dates(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 4
    name = F.when(k == 0, F.concat(F.lit("notice_"), F.date_format(d, "yyyyMMdd"), F.lit(".docx"))).when(k == 1, F.concat(F.lit("办法（"), F.year(d).cast("string"), F.lit("年"), F.month(d).cast("string"), F.lit("月）.docx"))).when(k == 2, F.lit("30001231.txt")).otherwise(F.concat(F.lit("a("), F.date_format(d, "yyyyMMdd"), F.lit(")b")))
    return o.select("o_orderkey", dates.file_name_date(name).alias("d"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN CASE WHEN o_orderkey % 3 = 0 THEN '2000-01' ELSE greatest('2000-01', strftime(o_orderdate, '%Y-%m-%d')) END ELSE CASE WHEN o_orderkey % 3 = 0 THEN '2000-01' ELSE strftime(o_orderdate, '%Y-%m-%d') END END AS d FROM orders")
def resolved_dates(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    own = F.when(F.col("o_orderkey") % 3 != 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
    return o.select("o_orderkey", dates.resolved_date(F.when(F.col("o_orderkey") % 2 == 0, "docx").otherwise("txt"), own, F.lit("2000-01")).alias("d"))


@query("WITH v AS (SELECT o_orderkey, (o_orderkey % 9999 + 1)::BIGINT AS m FROM orders) SELECT o_orderkey, CASE WHEN m % 1000 = 0 THEN m // 1000 ELSE m % 1000 END AS n, m FROM v")
def chinese_numerals(spark, sf_dir):
    """Numbers to numerals and back; 千 without value by default (so of 二千 the 二 is left), with its value on demand."""
    o = table(spark, sf_dir, "orders")
    n = (F.col("o_orderkey") % 9999 + 1).cast("int")
    digit = lambda d: F.element_at(F.array(*(F.lit(c) for c in "零一二三四五六七八九")), d + 1)
    k, h, t, u = F.floor(n / 1000).cast("int"), F.floor(n % 1000 / 100).cast("int"), F.floor(n % 100 / 10).cast("int"), n % 10
    thousands = F.when(k > 0, F.concat(digit(k), F.lit("千"))).otherwise("")
    hundreds = F.when(h > 0, F.concat(digit(h), F.lit("百"))).when((k > 0) & (n % 100 > 0), "零").otherwise("")
    tens = F.when((t == 1) & (k == 0) & (h == 0), "十").when(t > 0, F.concat(digit(t), F.lit("十"))).when((h > 0) & (u > 0), "零").otherwise("")
    text = F.concat(thousands, hundreds, tens, F.when(u > 0, digit(u)).otherwise(""))
    return o.select("o_orderkey", T.numeral_value(text).alias("n"), T.numeral_value(text, thousands=True).alias("m"))


_LAW = """lw AS (SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS line, o_orderkey % 11 AS k, translate((o_orderkey % 9 + 1)::VARCHAR, '123456789', '一二三四五六七八九') AS c FROM orders),
lt AS (SELECT doc_id, line, k, CASE WHEN k = 0 THEN concat('第', c, '章 总 则') WHEN k = 1 THEN concat('第', c, '节 范围') WHEN k = 2 THEN concat('第', c, '编 通则') WHEN k = 3 THEN '目 录' WHEN k < 9 THEN concat('第', c, '条  内容', line) ELSE concat('续文', line) END AS text, c FROM lw)"""
_KEPT = """lf AS (SELECT *, min(CASE WHEN k BETWEEN 4 AND 8 THEN line END) OVER (PARTITION BY doc_id) AS f FROM lt),
lc AS (SELECT *, CASE WHEN k = 0 AND line < f THEN line END AS listed FROM lf), lm AS (SELECT *, max(listed) OVER (PARTITION BY doc_id) AS last, min(listed) OVER (PARTITION BY doc_id) AS lo FROM lc),
lh AS (SELECT *, max(CASE WHEN listed < last THEN listed END) OVER (PARTITION BY doc_id) AS hi FROM lm),
kept AS (SELECT * FROM lh WHERE NOT coalesce(line < f AND (coalesce(listed < last, false) OR (k IN (1, 2) AND coalesce(line BETWEEN lo AND hi, false)) OR k = 3), false))"""


def _law_lines(spark, sf_dir):
    from pyspark.sql.window import Window

    o = table(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey") % 11, F.translate((F.col("o_orderkey") % 9 + 1).cast("string"), "123456789", "一二三四五六七八九")
    line = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    mark = lambda a, b: F.concat(F.lit("第"), c, F.lit(a), b)
    df = o.withColumn("line", line)
    n = F.col("line").cast("string")
    text = F.when(k == 0, mark("章 总 则", F.lit(""))).when(k == 1, mark("节 范围", F.lit(""))).when(k == 2, mark("编 通则", F.lit(""))).when(k == 3, "目 录").when(k < 9, mark("条  内容", n)).otherwise(F.concat(F.lit("续文"), n))
    return df.select(F.col("o_custkey").alias("doc_id"), "line", text.alias("text"))


@query(f"WITH {_LAW}, {_KEPT} SELECT doc_id, line, text FROM kept")
def toc_strip(spark, sf_dir):
    return structure.without_contents(_law_lines(spark, sf_dir)).select("doc_id", F.col("line").cast("long").alias("line"), "text")


@query(rf"""WITH {_LAW}, {_KEPT}, e AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS seq, regexp_replace(text, '\s+', ' ', 'g') AS t FROM kept),
h AS (SELECT *, max(CASE WHEN k = 0 THEN seq END) OVER w AS cs, max(CASE WHEN k = 1 THEN seq END) OVER w AS ss FROM e WINDOW w AS (PARTITION BY doc_id ORDER BY line)),
p AS (SELECT h.*, a.t AS ch, CASE WHEN ss > coalesce(cs, 0) THEN b.t END AS se FROM h LEFT JOIN e a ON a.doc_id = h.doc_id AND a.seq = h.cs LEFT JOIN e b ON b.doc_id = h.doc_id AND b.seq = h.ss)
SELECT doc_id, seq::INTEGER AS seq, CASE WHEN k IN (0, 1) THEN 'heading' WHEN k BETWEEN 4 AND 8 THEN 'article' ELSE 'paragraph' END AS kind, t AS text, concat_ws(' > ', ch, se) AS path, CASE WHEN k BETWEEN 4 AND 8 THEN concat('第', c, '条') END AS article_no, CASE WHEN k NOT IN (0, 1) AND NOT k BETWEEN 4 AND 8 THEN substr(t, 1, 20) END AS anchor_text FROM p""")
def law_headings(spark, sf_dir):
    e = structure.law_elements(_law_lines(spark, sf_dir))
    return e.select("doc_id", "seq", "kind", "text", F.array_join("location.heading_path", " > ").alias("path"), "location.article_no", "location.anchor_text")


@query(f"WITH {_LAW} SELECT doc_id, count(*) FILTER (k BETWEEN 4 AND 8) >= 3 AS structured FROM lt GROUP BY 1")
def law_detection(spark, sf_dir):
    return structure.law_structured(_law_lines(spark, sf_dir)).select("doc_id", "structured").distinct()


@query(f"WITH {_LAW}, n AS (SELECT doc_id, line, strpos('一二三四五六七八九', c)::BIGINT AS a FROM lt WHERE k BETWEEN 4 AND 8), g AS (SELECT doc_id, a, lead(a) OVER (PARTITION BY doc_id ORDER BY line) AS b FROM n) SELECT doc_id, a, b FROM g WHERE b <> a + 1")
def article_gaps(spark, sf_dir):
    """Neighbouring article numbers that don't follow each other."""
    from pyspark.sql.window import Window

    lines = _law_lines(spark, sf_dir)
    mark = T.unit_mark(F.col("text"), "条")
    n = lines.select("doc_id", "line", T.numeral_value(F.regexp_extract(mark, "第(.*)条", 1)).alias("a")).where("a is not null")
    return n.withColumn("b", F.lead("a").over(Window.partitionBy("doc_id").orderBy("line"))).where("b <> a + 1").select("doc_id", "a", "b")


# ---- sheets ----

_GRID = """g AS (SELECT p_partkey // 40 AS doc_id, p_partkey % 40 + 1 AS row, p_partkey % 40 AS k, p_name AS a, p_size::VARCHAR AS b, round(p_retailprice)::BIGINT::VARCHAR AS d FROM part)"""


def _grid(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    k = (F.col("p_partkey") % 40).cast("int")
    b, d = F.col("p_size").cast("string"), F.round("p_retailprice").cast("long").cast("string")
    arr = lambda *x: F.array(*(F.lit(v) if isinstance(v, str) else v for v in x))
    cells = (
        F.when(k == 0, arr("Table", "Table", "Table", "Table", "")).when(k == 1, arr("name", "size", "price", "note", "")).when(k == 2, arr("", "mm", "yuan", "free", ""))
        .when(k == 3, arr("1", "2", "3", "4", "")).when(k.isin(20, 21), arr("", "", "", "", "")).when(k == 30, arr("a footnote", "", "", "", "")).when(k == 31, arr("a footnote", "a footnote", "", "", "")).when(k == 32, arr("other", "", "", "", ""))
        .otherwise(arr(F.col("p_name"), b, d, "x", ""))
    )
    kinds = F.transform(cells, lambda c: F.when(c == "", "_").when(c.rlike("^-?[\\d,，.%\\s]+$"), "N").otherwise("T"))
    return p.select(F.floor(F.col("p_partkey") / 40).alias("doc_id"), F.lit(0).alias("sheet_no"), F.lit("S").alias("sheet_name"), (k + 1).alias("row"), cells.alias("cells"), kinds.alias("kinds"))


@query(f"WITH {_GRID} SELECT DISTINCT doc_id, 'TNNT' AS data_sig, min(row) FILTER (k > 3)::INTEGER AS data_start, 2 AS header_rows, 'name|size.mm|price.yuan|note.free' AS headers, 'ok' AS confidence FROM g GROUP BY doc_id")
def sheet_headers(spark, sf_dir):
    """Signature by majority, header rows above the data, joined column names."""
    s = structure.sheet_layout(_grid(spark, sf_dir)).groupBy("doc_id")
    return s.agg(F.first("data_sig").alias("data_sig"), F.first("data_start").alias("data_start"), F.first("header_rows").alias("header_rows"), F.array_join(F.first("headers"), "|").alias("headers"), F.first("confidence").alias("confidence"))


@query(f"""WITH {_GRID} SELECT doc_id, row::INTEGER AS seq, CASE WHEN k IN (30, 32) THEN 'paragraph' ELSE 'table_row' END AS kind,
CASE WHEN k = 30 THEN 'a footnote' WHEN k = 32 THEN 'other' ELSE concat('name=', a, ' | size.mm=', b, ' | price.yuan=', d, ' | note.free=x') END AS text,
(CASE WHEN k >= 21 THEN 2 ELSE 1 END)::INTEGER AS table_index, CASE WHEN k NOT IN (30, 32) THEN concat('r', row) END AS row_range
FROM g WHERE k > 3 AND k NOT IN (20, 21, 31)""")
def sheet_rows(spark, sf_dir):
    """Rows and footnotes; blank rows split tables, numbering rows go, a footnote repeated on the next row goes."""
    e = structure.sheet_elements(_grid(spark, sf_dir))
    return e.select("doc_id", "seq", "kind", "text", "location.table_index", "location.row_range")


@query("SELECT p_partkey, concat_ws(' | ', CASE WHEN p_size > 5 THEN concat('名称=', p_name) ELSE p_name END, CASE WHEN p_partkey % 3 <> 0 THEN concat('类=', p_type) END) AS bare, concat_ws(' | ', CASE WHEN p_size > 5 THEN concat('名称=', p_name) ELSE concat('=', p_name) END, CASE WHEN p_partkey % 3 <> 0 THEN concat('类=', p_type) END) AS marked FROM part")
def row_rendering(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    heads = F.array(F.when(F.col("p_size") > 5, "名称").otherwise(""), F.lit("类"))
    cells = F.array("p_name", F.when(F.col("p_partkey") % 3 != 0, F.col("p_type")).otherwise(""))
    return p.select("p_partkey", T.row_text(heads, cells).alias("bare"), T.row_text(heads, cells, bare=False).alias("marked"))


# ---- chunks and citations ----

@query("""WITH RECURSIVE x AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
p AS (SELECT doc_id, t, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i FROM (SELECT doc_id, unnest(l) AS t, unnest(range(len(l))) AS i FROM x) WHERE t <> ''),
w AS (SELECT doc_id, i, t AS held, 0 AS no, i AS beg FROM p WHERE i = 1
UNION ALL SELECT p.doc_id, p.i, CASE WHEN length(held) + length(t) > 400 THEN t ELSE held || chr(10) || t END, CASE WHEN length(held) + length(t) > 400 THEN no + 1 ELSE no END, CASE WHEN length(held) + length(t) > 400 THEN p.i ELSE beg END FROM w JOIN p ON p.doc_id = w.doc_id AND p.i = w.i + 1)
SELECT doc_id, no::INTEGER AS chunk_no, beg::INTEGER AS paragraph_seq, arg_max(held, i) AS text FROM w GROUP BY 1, 2, 3""")
def chunk_paragraph_pack(spark, sf_dir):
    """Lines of each document packed into chunks of up to 400 characters; a longer line stands alone."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text")).where("text <> ''")
    c = chunking.chunks_of(structure.plain_elements(lines))
    return c.select("doc_id", "chunk_no", "location.paragraph_seq", "text")


#: Parts p(doc_id, i, t) of texts too long for {limit} characters and x(doc_id, whole, long) become pieces z(doc_id, no, piece): packed while they fit, cut where one is too long.
_PIECES = """w AS (SELECT doc_id, i, t AS held, 0 AS no FROM p WHERE i = 0
UNION ALL SELECT p.doc_id, p.i, CASE WHEN length(held) + length(t) > {limit} THEN t ELSE held || t END, CASE WHEN length(held) + length(t) > {limit} THEN no + 1 ELSE no END FROM w JOIN p ON p.doc_id = w.doc_id AND p.i = w.i + 1),
h AS (SELECT doc_id, no, arg_max(held, i) AS t FROM w JOIN x USING (doc_id) WHERE long GROUP BY 1, 2 UNION ALL SELECT doc_id, 0, whole FROM x WHERE NOT long),
c AS (SELECT doc_id, no, t, unnest(range(0, length(t), {limit})) AS pos FROM h),
z AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY no, pos) - 1 AS no, substr(t, pos + 1, {limit}) AS piece FROM c)"""


@query(f"""WITH RECURSIVE o AS (SELECT o_orderkey AS doc_id, repeat('条件', (o_orderkey % 30)::INTEGER) AS r FROM orders),
p AS (SELECT doc_id, 0 AS i, '第一条 有下列情形的。' AS t FROM o UNION ALL SELECT doc_id, i, concat('（', ['一', '二', '三'][i], '）', r, '；') FROM o, (VALUES (1), (2), (3)) v(i)),
x AS (SELECT doc_id, string_agg(t, '' ORDER BY i) AS whole, length(string_agg(t, '' ORDER BY i)) > 60 AS long FROM p GROUP BY 1), {_PIECES.format(limit=60)}
SELECT doc_id, no::INTEGER AS chunk_no, no::VARCHAR AS suffix, piece AS text, '第一条' AS article_no FROM z""")
def chunk_article_split(spark, sf_dir):
    """Articles of composed law text with sub-articles, cut to 60 characters."""
    o = table(spark, sf_dir, "orders")
    part = lambda m: F.concat(F.lit(f"（{m}）"), F.repeat(F.lit("条件"), (F.col("o_orderkey") % 30).cast("int")), F.lit("；"))
    text = F.concat(F.lit("第一条 "), F.lit("有下列情形的。"), part("一"), part("二"), part("三"))
    e = o.select(F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("seq"), F.lit("article").alias("kind"), text.alias("text"), structure.location(article_no=F.lit("第一条"), paragraph_seq=F.lit(1)).alias("location"))
    return chunking.chunks_of(e, limit=60).select("doc_id", "chunk_no", "suffix", "text", "location.article_no")


@query(f"""WITH RECURSIVE o AS (SELECT o_orderkey AS doc_id, [repeat('甲', (o_orderkey % 50 + 1)::INTEGER), repeat('乙', (o_orderkey % 70 + 1)::INTEGER), repeat('丙', (o_orderkey % 30)::INTEGER)] AS s FROM orders),
x AS (SELECT doc_id, '第二条 ' || array_to_string(s, '。') AS whole, length('第二条 ' || array_to_string(s, '。')) > 40 AS long FROM o),
p AS (SELECT doc_id, i, CASE WHEN i = 0 THEN '第二条 ' ELSE '' END || s[i + 1] || '。' AS t FROM o, (VALUES (0), (1), (2)) v(i) WHERE i < 2 OR s[3] <> ''), {_PIECES.format(limit=40)}
SELECT doc_id, no::INTEGER AS chunk_no, no::VARCHAR AS suffix, piece AS text FROM z""")
def chunk_recursive(spark, sf_dir):
    """Articles without sub-articles: cut at full stops, every segment of a cut text ending in one, and by length where none helps."""
    o = table(spark, sf_dir, "orders")
    n = F.col("o_orderkey")
    text = F.concat(F.lit("第二条 "), F.repeat(F.lit("甲"), (n % 50 + 1).cast("int")), F.lit("。"), F.repeat(F.lit("乙"), (n % 70 + 1).cast("int")), F.lit("。"), F.repeat(F.lit("丙"), (n % 30).cast("int")))
    e = o.select(n.alias("doc_id"), F.lit(1).alias("seq"), F.lit("article").alias("kind"), text.alias("text"), structure.location(article_no=F.lit("第二条"), paragraph_seq=F.lit(1)).alias("location"))
    return chunking.chunks_of(e, limit=40).select("doc_id", "chunk_no", "suffix", "text")


@query("""SELECT p_partkey AS doc_id, 0 AS chunk_no, '' AS suffix, substr(concat(p_name, ' | ', repeat(p_type, (p_partkey % 90)::INTEGER)), 1, 800) AS text, 'r2' AS row_range FROM part""")
def chunk_table_rows(spark, sf_dir):
    """Rows of tables stand alone, cut off at twice the limit."""
    p = table(spark, sf_dir, "part")
    text = F.concat("p_name", F.lit(" | "), F.repeat(F.col("p_type"), (F.col("p_partkey") % 90).cast("int")))
    e = p.select(F.col("p_partkey").alias("doc_id"), F.lit(2).alias("seq"), F.lit("table_row").alias("kind"), text.alias("text"), structure.location(row_range=F.lit("r2")).alias("location"))
    return chunking.chunks_of(e).select("doc_id", "chunk_no", "suffix", "text", "location.row_range")


@query("SELECT doc_id, substr(sha1(concat(doc_id, '|', CASE WHEN doc_id % 2 = 0 THEN '第一条' ELSE 'None' END, '|', doc_id % 10, '|None|', CASE WHEN doc_id % 3 = 0 THEN 'r1' ELSE 'None' END, '|', CASE WHEN doc_id % 2 = 0 THEN '0' ELSE '' END, '|', text)), 1, 16) AS chunk_id FROM documents")
def chunk_ids(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    n = F.col("doc_id")
    loc = structure.location(article_no=F.when(n % 2 == 0, "第一条"), paragraph_seq=n % 10, row_range=F.when(n % 3 == 0, "r1"))
    return d.select("doc_id", chunking.chunk_id(n.cast("string"), loc, F.when(n % 2 == 0, "0").otherwise(""), F.col("text")).alias("chunk_id"))


def _places(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    n = F.col("o_orderkey")
    on = lambda m, r, v: F.when(n % m == r, v)
    loc = structure.location(
        heading_path=F.when(n % 3 == 0, F.array(F.lit("法"), F.lit("章"), F.lit("节"))).when(n % 3 == 1, F.array(F.lit("章"))), article_no=on(5, 0, "第一条"), paragraph_seq=F.when(n % 4 != 0, n % 100), anchor_text=on(2, 0, "起首"),
        sheet_name=F.when(n % 7 != 0, "表单"), table_index=F.when(n % 11 != 0, F.lit(2)), row_range=F.when(n % 13 != 0, "r5"), column_names=F.when(n % 2 == 0, F.array(F.lit("列"))), column_names_confidence=F.when(n % 6 == 0, "uncertain").otherwise("ok"),
    )
    return o.select("o_orderkey", F.lit("f.x").alias("file_name"), F.when(n % 9 != 0, "税法").otherwise("").alias("doc_title"), F.when(n % 8 < 3, "xlsx").otherwise("docx").alias("format"), F.lit("abc12345").alias("doc_version"), (n % 2).alias("is_latest"), loc.alias("location"))


_PLACES = """pl AS (SELECT o_orderkey AS n, CASE WHEN n % 9 <> 0 THEN '税法' ELSE '' END AS title, n % 8 < 3 AS x, CASE WHEN n % 3 = 0 THEN ['法', '章', '节'] WHEN n % 3 = 1 THEN ['章'] ELSE [] END AS hp, CASE WHEN n % 5 = 0 THEN '第一条' END AS art, CASE WHEN n % 4 <> 0 THEN n % 100 END AS seq, CASE WHEN n % 2 = 0 THEN '起首' END AS anc,
CASE WHEN n % 7 <> 0 THEN '表单' END AS sh, CASE WHEN n % 11 <> 0 THEN 2 END AS ti, CASE WHEN n % 13 <> 0 THEN 'r5' END AS rr, n % 2 = 0 AS cols, n % 6 = 0 AS unc FROM orders),
lv AS (SELECT *, CASE WHEN x THEN CASE WHEN sh IS NOT NULL AND ti IS NOT NULL AND rr IS NOT NULL AND cols THEN CASE WHEN unc THEN 'B' ELSE 'A' END WHEN sh IS NOT NULL THEN 'B' ELSE 'C' END
WHEN art IS NOT NULL OR (len(hp) > 0 AND seq IS NOT NULL) THEN CASE WHEN title <> '' THEN 'A' ELSE 'B' END WHEN seq IS NOT NULL AND (anc IS NOT NULL OR title <> '') THEN CASE WHEN title <> '' AND anc IS NOT NULL THEN 'A' ELSE 'B' END ELSE 'C' END AS level FROM pl)"""


@query(f"WITH {_PLACES} SELECT n AS o_orderkey, level FROM lv")
def citation_level(spark, sf_dir):
    return _places(spark, sf_dir).select("o_orderkey", citations.citation_level(F.col("file_name"), F.col("doc_title"), F.col("format"), F.col("location")).alias("level"))


def _cited(spark, sf_dir):
    p = _places(spark, sf_dir).withColumn("level", citations.citation_level(F.col("file_name"), F.col("doc_title"), F.col("format"), F.col("location")))
    return p.withColumn("citation", citations.citation(*(F.col(c) for c in ("file_name", "doc_title", "format", "doc_version", "is_latest", "location", "level"))))


@query(f"""WITH {_PLACES} SELECT n AS o_orderkey, concat(concat_ws(' · ', CASE WHEN title <> '' THEN '《税法》' ELSE 'f.x' END,
CASE WHEN art IS NOT NULL THEN concat_ws(' · ', CASE WHEN len(hp) > 1 THEN array_to_string(hp[2:], ' > ') END, art) WHEN x AND sh IS NOT NULL THEN concat('sheet:', sh, ' 表', coalesce(ti::VARCHAR, 'None'), ' 行', coalesce(rr, 'None'))
WHEN len(hp) > 0 THEN concat_ws(' · ', array_to_string(hp, ' > '), CASE WHEN seq IS NOT NULL THEN concat('段', seq) END) WHEN seq IS NOT NULL THEN concat_ws(' · ', concat('段', seq), CASE WHEN anc IS NOT NULL THEN concat('“', anc, '…”') END) END),
' [vabc12345]', CASE WHEN n % 2 = 0 THEN '（历史版本）' ELSE '' END, CASE WHEN level = 'B' THEN '（引用定位不完整）' ELSE '' END, CASE WHEN unc THEN '（列名可能不准确,请核对原表）' ELSE '' END) AS citation FROM lv""")
def citation_string(spark, sf_dir):
    return _cited(spark, sf_dir).select("o_orderkey", "citation")


@query(f"WITH {_PLACES} SELECT level, count(*) AS n, round_even(count(*) / sum(count(*)) OVER ()::DOUBLE, 3) AS share FROM lv GROUP BY 1")
def level_histogram(spark, sf_dir):
    levels = _cited(spark, sf_dir).groupBy("level").agg(F.count("*").alias("n"))
    total = levels.agg(F.sum("n").alias("t"))
    return levels.join(F.broadcast(total), F.lit(True)).select("level", "n", F.bround(F.col("n") / F.col("t"), 3).alias("share"))


# ---- answers ----

def _retrieved(spark, sf_dir):
    """The best five of all documents for each benchmark text as its evidence, graded by id."""
    found = bm25.retrieve(bm25.build(_document_chunks(spark, sf_dir)), _questions(spark, sf_dir)).select("qid", "rank", "chunk_ix", "score", "text")
    source = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_ix"), "source")
    level = F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), (1 + F.col("chunk_ix") % 3).cast("int"))
    return found.join(source, "chunk_ix").select("qid", "rank", "score", level.alias("citation_level"), F.concat(F.lit("《"), "source", F.lit("》")).alias("citation"), "text", F.col("chunk_ix").cast("string").alias("chunk_id"))


_RETRIEVED = f"{_DOC_CHUNKS.format(latest=1)}, {_QUESTIONS.format(hist='false')}, {_SCORES}, k AS (SELECT qid, rank, chunk_ix, score FROM r WHERE rank <= 5)"


@query(f"""WITH {_RETRIEVED}, g AS (SELECT qid, count(*) AS n, count(*) FILTER (chunk_ix % 3 = 2) AS c FROM k WHERE score >= 21 GROUP BY 1)
SELECT item_id AS qid, coalesce(n, 0) AS n_hits, coalesce(c, 0) AS n_low, CASE WHEN n IS NULL THEN 'refuse_no_hit' WHEN n = c THEN 'refuse_low_trust' WHEN c > 0 THEN 'degraded' ELSE 'ok' END AS verdict FROM benchmark LEFT JOIN g ON qid = item_id""")
def triage_verdict(spark, sf_dir):
    """Triage of the best five of all documents for each benchmark text."""
    return generation.triage(_questions(spark, sf_dir).select("qid"), _retrieved(spark, sf_dir), min_score=21)


@query(f"""WITH {_RETRIEVED}, n AS (SELECT qid, rank, concat('[', rank, '] 《', source, '》', CASE WHEN chunk_ix % 3 = 2 THEN '【来源定位不完整】' ELSE '' END, chr(10), text) AS b FROM k JOIN documents ON doc_id = chunk_ix),
g AS (SELECT qid, string_agg(b, chr(10) || chr(10) ORDER BY rank) AS c FROM n GROUP BY 1)
SELECT item_id AS qid, concat('【检索到的法规内容】', chr(10), coalesce(c, ''), chr(10), chr(10), '【问题】', chr(10), text) AS prompt FROM benchmark LEFT JOIN g ON qid = item_id""")
def prompt_render(spark, sf_dir):
    """Prompts with the best five of all documents for each benchmark text."""
    return generation.prompts(_questions(spark, sf_dir).select("qid", "question"), _retrieved(spark, sf_dir)).select("qid", "prompt")


def _stub(prompt: str) -> str:
    return T.REFUSAL.replace(",", "，") if len(prompt) % 3 == 0 else f"答案 [1] {len(prompt)}"


@query(f"""WITH {_RETRIEVED}, n AS (SELECT qid, rank, chunk_ix, '《' || source || '》' AS cited, concat('[', rank, '] 《', source, '》', CASE WHEN chunk_ix % 3 = 2 THEN '【来源定位不完整】' ELSE '' END, chr(10), text) AS b FROM k JOIN documents ON doc_id = chunk_ix),
g AS (SELECT qid, count(*) AS n, count(*) FILTER (chunk_ix % 3 = 2) AS c, string_agg(b, chr(10) || chr(10) ORDER BY rank) AS shown, string_agg(cited, '|' ORDER BY rank) AS citations, string_agg(chunk_ix::VARCHAR, '|' ORDER BY rank) AS used FROM n GROUP BY 1),
v AS (SELECT item_id AS qid, CASE WHEN n IS NULL THEN 'refuse_no_hit' WHEN n = c THEN 'refuse_low_trust' WHEN c > 0 THEN 'degraded' ELSE 'ok' END AS verdict, length(concat('【检索到的法规内容】', chr(10), coalesce(shown, ''), chr(10), chr(10), '【问题】', chr(10), text)) AS size, citations, used FROM benchmark LEFT JOIN g ON qid = item_id),
a AS (SELECT *, verdict IN ('ok', 'degraded') AS asked, verdict IN ('ok', 'degraded') AND size % 3 = 0 AS gave_up FROM v)
SELECT qid, verdict, CASE WHEN verdict = 'refuse_no_hit' OR gave_up THEN '知识库中未找到足够依据,无法回答。' WHEN verdict = 'refuse_low_trust' THEN '找到疑似相关内容,但无法可信溯源,不作答。' ELSE concat('答案 [1] ', size) END AS text,
CASE WHEN gave_up OR verdict = 'refuse_no_hit' THEN '' ELSE citations END AS citations, NOT asked OR gave_up AS refused, (verdict = 'degraded' AND NOT gave_up) OR verdict = 'refuse_low_trust' AS degraded, CASE WHEN asked AND NOT gave_up THEN used ELSE '' END AS chunks_used FROM a""")
def answer_generation(spark, sf_dir):
    """Answers by a stub of a model, with refusals of its own, on evidence from all documents."""
    a = generation.answers(_questions(spark, sf_dir).select("qid", "question"), _retrieved(spark, sf_dir), _stub).drop("sec")
    return a.withColumns({c: F.array_join(c, "|") for c in ("citations", "chunks_used")})


@query("""WITH b AS (SELECT item_id::VARCHAR AS qid, text AS question, concat('2020年1月', item_id % 28 + 1, '日') AS golden_answer FROM benchmark), a AS (SELECT *, concat('于', golden_answer, '施行') AS answer_text FROM b),
s AS (SELECT *, CASE WHEN qid::BIGINT % 4 = 0 THEN 'cache' WHEN length(concat(question, chr(10), golden_answer, chr(10), answer_text)) % 2 = 1 THEN 'llm' ELSE 'fallback' END AS source FROM a)
SELECT qid, question, golden_answer, answer_text, substr(sha1(concat(qid, '|', golden_answer, '|', answer_text)), 1, 20) AS key, CASE source WHEN 'cache' THEN 'partial' ELSE 'correct' END AS verdict,
CASE source WHEN 'cache' THEN 'r' WHEN 'llm' THEN '同' ELSE 'LLM-judge 不可用,回退字符串粗判' END AS reason, source FROM s""")
def answer_judging(spark, sf_dir):
    """Verdicts by cache, stub or answer keys."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("qid"), F.col("text").alias("question"), F.concat(F.lit("2020年1月"), (F.col("item_id") % 28 + 1).cast("string"), F.lit("日")).alias("golden_answer"))
    b = b.withColumn("answer_text", F.concat(F.lit("于"), "golden_answer", F.lit("施行")))
    cached = b.where("qid % 4 = 0").select(generation.judge_key(F.col("qid"), F.col("golden_answer"), F.col("answer_text")).alias("key"), F.lit("partial").alias("verdict"), F.lit("r").alias("reason"))
    return generation.judged(b, cached, lambda p: '评分：{"verdict": "correct", "reason": "同"}' if len(p) % 2 else "?", prompt=lambda q, g, a: F.concat_ws("\n", q, g, a))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'correct' WHEN 1 THEN 'partial' WHEN 2 THEN 'incorrect' END AS verdict FROM orders""")
def verdict_parsing(spark, sf_dir):
    k = F.col("o_orderkey") % 4
    raw = F.when(k == 0, '```json\n{“verdict”: “correct”, “reason”: “同”}\n```').when(k == 1, '好的 {"verdict": "partial", reason: bad}').when(k == 2, '{"a": 1} {"verdict":"incorrect","reason":"x"} end').otherwise('{"verdict": "maybe"}')
    return table(spark, sf_dir, "orders").select("o_orderkey", generation.parse_verdict(raw)["verdict"].alias("verdict"))


@query("SELECT o_orderkey, translate(o_orderkey::VARCHAR || '%():', '', '') AS half, o_orderkey % 3 <> 0 AS holds, o_orderkey % 2 = 0 AS refuses FROM orders")
def answer_keys_match(spark, sf_dir):
    """Full width to half width, answer keys, refusals."""
    o = table(spark, sf_dir, "orders")
    n = F.col("o_orderkey").cast("string")
    wide = F.concat(F.translate(n, "0123456789", "０１２３４５６７８９"), F.lit("　％（ ）："))
    golden = F.concat(F.lit("利率为"), (1000 + F.col("o_orderkey") % 50).cast("string"), F.lit("．25%，自２０２０年１月２日起"))
    said = F.concat(F.lit("约"), (1000 + F.col("o_orderkey") % 50).cast("string"), F.when(F.col("o_orderkey") % 3 == 1, ".2501%").when(F.col("o_orderkey") % 3 == 2, ".25%").otherwise(".25倍"), F.when(F.col("o_orderkey") % 3 == 0, "，2020年1月3日").otherwise("，2020年1月2日"))
    refusal = F.when(F.col("o_orderkey") % 2 == 0, " 知识库中未找到足够依据， 无法回答。见附件").otherwise("依据[1]，可以")
    return o.select("o_orderkey", T.half_width(wide).alias("half"), T.holds_answer(golden, said).alias("holds"), T.refuses(refusal).alias("refuses"))


# ---- evaluation ----

_EVAL = """q AS (SELECT item_id AS qid, ['docx', 'txt', 'xlsx'][1 + item_id % 3] AS format, CASE WHEN item_id % 10 = 9 THEN 'refuse' WHEN item_id % 2 = 0 THEN 'fact' ELSE 'table' END AS qtype, item_id % 4 AS k FROM benchmark),
h AS (SELECT qid, concat('f', (qid + d) % 12, '.txt') AS file_name, CASE WHEN qid % 5 < 3 THEN '第一条' ELSE '第二条' END AS article_no, concat('t', (qid + d) % 12) AS doc_title FROM q, (VALUES (0), (1), (2)) v(d)),
x AS (SELECT qid, concat('f', (qid + k) % 12, '.txt') AS file FROM q UNION ALL SELECT qid, concat('f', (qid + 1) % 12, '.txt') FROM q WHERE k = 1),
tw AS (SELECT * FROM (VALUES ('f3.txt', 'f1.txt'), ('f1.txt', 'f3.txt'), ('f6.txt', 'f4.txt'), ('f4.txt', 'f6.txt')) v(a, b)),
xf AS (SELECT qid, file, file AS same FROM x UNION SELECT qid, file, b FROM x JOIN tw ON a = file),
hit AS (SELECT x.qid, x.file, bool_or(h.file_name IS NOT NULL) AS ok FROM xf x LEFT JOIN h ON h.qid = x.qid AND h.file_name = x.same GROUP BY 1, 2),
fo AS (SELECT qid, bool_and(ok) AS f_ok FROM hit GROUP BY 1),
lo AS (SELECT DISTINCT x.qid FROM xf x JOIN h ON h.qid = x.qid AND h.file_name = x.same AND h.article_no = '第一条'),
ev AS (SELECT q.*, f_ok, f_ok AND (k = 2 OR lo.qid IS NOT NULL) AS l_ok FROM q JOIN fo USING (qid) LEFT JOIN lo USING (qid)),
an AS (SELECT ev.*, qid % 3 = 0 AS refused, qid % 5 <> 1 AS key_ok, (qid % 7)::DOUBLE AS sec, f_ok OR EXISTS (SELECT 1 FROM h WHERE h.qid = ev.qid AND h.doc_title = concat('t', (ev.qid + 2) % 12)) AS cited FROM ev),
fin AS (SELECT qid, qtype, format, CASE WHEN qtype = 'refuse' THEN refused ELSE cited AND key_ok AND NOT refused END AS ok, CASE WHEN qtype <> 'refuse' THEN cited END AS cite_ok, CASE WHEN qtype <> 'refuse' THEN key_ok END AS key_ok, refused, sec FROM an)"""


def _evaluated(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    n = F.col("item_id")
    f = lambda i: F.concat(F.lit("f"), (i % 12).cast("string"), F.lit(".txt"))
    k = n % 4
    path = F.when(k == 1, F.concat(F.lit("a/"), f(n + k), F.lit(" + b/"), f(n + 1))).otherwise(F.concat(F.lit("a/"), f(n + k)))
    source = F.struct(F.concat(F.lit("t"), ((n + 2) % 12).cast("string")).alias("doc_title"), path.alias("file_path"), F.when(k == 2, "表1").otherwise("正文第一条").alias("locator"))
    q = b.select(n.alias("qid"), F.element_at(F.array(F.lit("docx"), F.lit("txt"), F.lit("xlsx")), (1 + n % 3).cast("int")).alias("format"), F.when(n % 10 == 9, "refuse").when(n % 2 == 0, "fact").otherwise("table").alias("qtype"), source.alias("expected_source"), F.lit("2020年").alias("golden_answer"))
    h = b.select(n.alias("qid"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("d"))
    at = F.col("qid") + F.col("d")
    h = h.select("qid", f(at).alias("file_name"), F.when(F.col("qid") % 5 < 3, "第一条").otherwise("第二条").alias("article_no"), F.concat(F.lit("t"), (at % 12).cast("string")).alias("doc_title"))
    pairs = spark.createDataFrame([("f3.txt", "f1.txt"), ("f6.txt", "f4.txt")], "file string, same string")
    answers = b.select(n.alias("qid"), F.when(n % 5 != 1, "于2020年").otherwise("不详").alias("text"), (n % 3 == 0).alias("refused"))
    return q, h, evaluation.equivalents(pairs), answers


@query(f"WITH {_EVAL} SELECT qid, f_ok, l_ok FROM ev")
def eval_hits(spark, sf_dir):
    q, h, twins, _ = _evaluated(spark, sf_dir)
    return evaluation.hits_of_files(q, h, twins)


@query(f"WITH {_EVAL}, e AS (SELECT * FROM ev WHERE qtype <> 'refuse') SELECT format, count(*) AS n, round_even(avg(f_ok::INT), 2)::DOUBLE AS file_hit, round_even(avg(l_ok::INT), 2)::DOUBLE AS loc_hit FROM e GROUP BY 1 UNION ALL SELECT NULL, count(*), round_even(avg(f_ok::INT), 3)::DOUBLE, round_even(avg(l_ok::INT), 3)::DOUBLE FROM e")
def eval_retrieval(spark, sf_dir):
    q, h, twins, _ = _evaluated(spark, sf_dir)
    return evaluation.retrieval_metrics(q, h, twins)


def _verdicts(spark, sf_dir):
    q, h, twins, answers = _evaluated(spark, sf_dir)
    return evaluation.verdicts(q, answers, h, twins).withColumn("sec", (F.col("qid") % 7).cast("double"))


@query(f"WITH {_EVAL} SELECT qid, ok, cite_ok, key_ok, refused FROM fin")
def eval_verdicts(spark, sf_dir):
    return _verdicts(spark, sf_dir).select("qid", "ok", "cite_ok", "key_ok", "refused")


@query(f"WITH {_EVAL} SELECT count(*) AS n, round_even(avg(ok::INT), 3)::DOUBLE AS accuracy, count(*) FILTER (sec > 5) AS over_5s, count(*) FILTER (refused AND ok) AS refuse_correct FROM fin")
def eval_full_metrics(spark, sf_dir):
    return evaluation.full_metrics(_verdicts(spark, sf_dir))


@query(f"""WITH {_EVAL} SELECT 'qtype' AS by, qtype AS value, count(*) AS n, count(*) FILTER (ok) AS ok, round_even(avg(ok::INT), 3)::DOUBLE AS acc FROM fin GROUP BY 2
UNION ALL SELECT 'format', format, count(*), count(*) FILTER (ok), round_even(avg(ok::INT), 3)::DOUBLE FROM fin GROUP BY 2 UNION ALL SELECT 'all', '', count(*), count(*) FILTER (ok), round_even(avg(ok::INT), 3)::DOUBLE FROM fin""")
def eval_grouped(spark, sf_dir):
    return evaluation.grouped_accuracy(_verdicts(spark, sf_dir))


_JUDGED = "j AS (SELECT doc_id AS qid, CASE WHEN doc_id % 9 = 0 THEN 'refuse' ELSE 'fact' END AS qtype, CASE WHEN doc_id % 7 = 0 THEN 'partial' WHEN doc_id % 13 = 0 THEN 'incorrect' ELSE 'correct' END AS verdict, CASE WHEN doc_id % 5 = 0 THEN 'fallback' ELSE 'llm' END AS source, quality = 1 AS human FROM labels)"


def _judged(spark, sf_dir):
    n = F.col("doc_id")
    return table(spark, sf_dir, "labels").select(n.alias("qid"), F.when(n % 9 == 0, "refuse").otherwise("fact").alias("qtype"), F.when(n % 7 == 0, "partial").when(n % 13 == 0, "incorrect").otherwise("correct").alias("verdict"), F.when(n % 5 == 0, "fallback").otherwise("llm").alias("source"), (F.col("quality") == 1).alias("human"))


@query(f"WITH {_JUDGED} SELECT count(*) AS n, count(*) FILTER (verdict = 'correct') AS correct, count(*) FILTER (verdict = 'partial') AS partial, count(*) FILTER (verdict = 'incorrect') AS incorrect, round_even(avg((verdict = 'correct')::INT), 3)::DOUBLE AS strict_rate, round_even(avg((verdict <> 'incorrect')::INT), 3)::DOUBLE AS lenient_rate, count(*) FILTER (source = 'fallback') AS fallback_used FROM j")
def judge_stats(spark, sf_dir):
    return evaluation.judge_stats(_judged(spark, sf_dir))


@query(f"WITH {_JUDGED}, a AS (SELECT (verdict = 'correct') = human AS agree FROM j WHERE qtype <> 'refuse') SELECT count(*) AS n, round_even(avg(agree::INT), 3)::DOUBLE AS agreement, round_even(avg(agree::INT), 3)::DOUBLE >= 0.95 AS passed FROM a")
def judge_calibrate(spark, sf_dir):
    j = _judged(spark, sf_dir)
    return evaluation.calibration(j.drop("human"), j.select("qid", "human"))


@query(f"WITH {_JUDGED} SELECT qid, human, verdict FROM j WHERE qtype <> 'refuse' AND (verdict = 'correct') <> human")
def judge_mismatches(spark, sf_dir):
    j = _judged(spark, sf_dir)
    return evaluation.mismatches(j.drop("human"), j.select("qid", "human"))


@query(f"WITH {_JUDGED} SELECT qid, human AS ok, CASE WHEN qid % 4 = 0 THEN 'seen' END AS note, CASE WHEN human THEN 'pass' WHEN qid % 4 = 0 THEN 'reviewed' ELSE 'fail' END AS state FROM j")
def report_appendix(spark, sf_dir):
    j = _judged(spark, sf_dir).select("qid", F.col("human").alias("ok"))
    return evaluation.appendix(j, j.where("qid % 4 = 0").select("qid", F.lit("seen").alias("note")))


# ---- readers ----

@query(r"""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN concat('首行', o_orderkey) ELSE concat('规则', o_orderkey) END AS doc_title, CASE WHEN o_orderkey % 3 = 0 THEN 'body_first_line' ELSE 'txt_header' END AS title_source,
CASE WHEN o_orderkey % 2 = 0 THEN concat('2020-03-', lpad((o_orderkey % 28 + 1)::VARCHAR, 2, '0')) ELSE '2001-05' END AS effective_date, concat('http://x/', o_orderkey) AS source_url FROM orders""")
def text_headers(spark, sf_dir):
    """Title, date and link of composed text files, with the fallbacks."""
    o = table(spark, sf_dir, "orders")
    n, shown = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    text = F.concat(
        F.when(n % 3 == 0, "").otherwise(F.concat(F.lit("标题：规则"), shown, F.lit("\n"))), F.lit("发布日期：2001-05\n来源：局\n原文链接：http://x/"), shown,
        F.when(n % 5 == 0, "\n").otherwise("\n正文：\n"), F.lit("无障碍浏览\n下载文字版\n首行"), shown,
        F.when(n % 2 == 0, F.concat(F.lit("\n2020年3月"), (n % 28 + 1).cast("string"), F.lit("日公布"))).otherwise(""),
    )
    return files.text_header(o.select("o_orderkey", text.alias("text")), key="o_orderkey").select("o_orderkey", "doc_title", "title_source", "effective_date", "source_url")


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN '关于税收管理的若干规定' WHEN 1 THEN '税收管理办法' WHEN 2 THEN '正文。' WHEN 3 THEN '' ELSE repeat('长', 61) END AS title, CASE WHEN o_orderkey % 5 < 2 THEN 'first_para' ELSE 'FAIL' END AS title_source FROM orders""")
def word_titles(spark, sf_dir):
    """Titles of word files: joined where they break off, failed where they can't be titles."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey") % 5
    lines = lambda *x: F.array(*(F.lit(v) for v in x)).cast("array<string>")
    texts = F.when(k == 0, lines("关于税收管理", "的若干规定")).when(k == 1, lines("税收管理办法", "第一条 总则")).when(k == 2, lines("正文。")).when(k == 3, lines()).otherwise(lines("长" * 61))
    title, source = files.word_title(F.col("texts"))
    return o.select("o_orderkey", texts.alias("texts")).select("o_orderkey", title.alias("title"), source.alias("title_source"))


@query("""WITH e AS (SELECT o_orderkey, o_custkey, unnest([1, 2, 5, 6, 7]) AS seq FROM orders)
SELECT o_orderkey, seq::INTEGER AS seq, CASE seq WHEN 5 THEN 'table_row' WHEN 6 THEN 'paragraph' WHEN 7 THEN 'article' ELSE 'heading' END AS kind,
CASE seq WHEN 1 THEN concat('T', o_orderkey) WHEN 2 THEN 'S' WHEN 5 THEN concat('a=', o_custkey, ' | b=x') WHEN 6 THEN concat('item ', o_orderkey) ELSE '第一条 内容' END AS text,
CASE seq WHEN 1 THEN concat('T', o_orderkey) ELSE concat('T', o_orderkey, ' > S') END AS path, CASE WHEN seq = 5 THEN 'r5' END AS row_range, CASE WHEN seq = 5 THEN '表A' END AS sheet_name FROM e""")
def markdown_structure(spark, sf_dir):
    """Headings, a table, an item and an article of composed Markdown with front matter."""
    o = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", rows=50_000)
    shown = F.col("o_orderkey").cast("string")
    text = F.concat(F.lit("---\nsheet_name: 表A\n---\n# T"), shown, F.lit("\n\n## S\n| a | b |\n| --- | --- |\n| "), F.col("o_custkey").cast("string"), F.lit(" | x |\n- item "), shown, F.lit("\n> 第一条 内容\n"))
    e = structure.markdown_elements(o.select("o_orderkey", text.alias("text")), key="o_orderkey")
    return e.select("o_orderkey", "seq", "kind", "text", F.array_join("location.heading_path", " > ").alias("path"), "location.row_range", "location.sheet_name")


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN concat('关于', p_name, '的通知') WHEN 1 THEN concat(replace(p_name, ' ', ''), '管理办法') WHEN 2 THEN NULL ELSE concat('税法(', p_partkey, ')税法') END AS t FROM part")
def normalised_titles(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey") % 4
    title = (
        F.when(k == 0, F.concat(F.lit("《关于"), F.translate("p_name", " ", "~"), F.lit("的通知》（2018年修订）")))
        .when(k == 1, F.concat("p_name", F.lit(" 管理　办法(2019年12月第二次修正)")))
        .when(k == 2, "短标题").otherwise(F.concat(F.lit("税法("), F.col("p_partkey").cast("string"), F.lit(")税法")))
    )
    return p.select("p_partkey", F.translate(T.norm_title(title), "~", " ").alias("t"))


@query(f"WITH {_REGISTRY} SELECT format, count(*) FILTER (status NOT LIKE 'ERROR%') AS parsed, count(*) FILTER (status LIKE 'ERROR%') AS failed FROM reg GROUP BY 1")
def parse_counts(spark, sf_dir):
    return registry.parse_counts(_registry(spark, sf_dir))


@query(f"WITH {_PLACES} SELECT n AS o_orderkey, concat('[1] 0.500 ', CASE WHEN title <> '' THEN '《税法》' ELSE 'f.x' END, ' | ', repeat('ab ', 40)) AS line FROM lv")
def hit_listing(spark, sf_dir):
    """Hits as lines: newlines shown as spaces, the text cut at 120 characters."""
    from lexquarry.plans.corpus import listing

    p = _places(spark, sf_dir).select(F.col("o_orderkey").alias("qid"), F.lit(1).alias("rank"), F.lit(0.5).alias("score"), F.when(F.col("doc_title") != "", F.lit("《税法》")).otherwise("f.x").alias("citation"), F.lit("ab\n" * 60).alias("text"))
    return listing(p).select(F.col("qid").alias("o_orderkey"), "line")


@query(r"""WITH t AS (SELECT o_orderkey, unnest([concat('正文', o_orderkey), '第二行']) AS text, unnest([1, 2]) AS line FROM orders UNION ALL SELECT o_orderkey, concat('前言', o_orderkey), 0 FROM orders WHERE o_orderkey % 2 = 1)
SELECT o_orderkey, (line + CASE WHEN o_orderkey % 2 = 1 THEN 1 ELSE 0 END)::INTEGER AS line, text FROM t""")
def text_reader(spark, sf_dir):
    """Lines below the mark of the body, or all without it; headers, blanks and page furniture go."""
    o = table(spark, sf_dir, "orders")
    shown = F.col("o_orderkey").cast("string")
    top = F.concat(F.lit("标题：规则\n发布日期：2001-05\n前言"), shown, F.lit("\n"), F.when(F.col("o_orderkey") % 2 == 0, "正文：　\n").otherwise("栏目：x\n"))
    text = F.concat(top, F.lit("无障碍浏览\n \u3000\n　正文"), shown, F.lit("\u200b \n点此下载文字版\n第二行\n来源：局\n"))
    return files.text_lines(o.select("o_orderkey", text.alias("text")), key="o_orderkey")


#: Bytes in hex, and the text they stand for.
_BYTES = [
    ("E6A08731", "标1"), ("C4FACAC7", "\ufffd\ufffd\ufffd\ufffd"), ("E6A0", "\ufffd"), ("61F09F98", "a\ufffd"), ("C0AF", "\ufffd\ufffd"), ("EDA080", "\ufffd\ufffd\ufffd"),
    ("F4908080", "\ufffd\ufffd\ufffd\ufffd"), ("0D0A610D62", "\na\nb"), ("FF41FE", "\ufffdA\ufffd"), ("", ""), ("EFBBBF41", "\ufeffA"), ("E6A0C3A9", "\ufffdé"),
]


@query(f"""SELECT o_orderkey, concat([{", ".join("'" + t.replace(chr(10), "' || chr(10) || '") + "'" for _, t in _BYTES)}][(o_orderkey % {len(_BYTES)} + 1)::INTEGER], '|', o_orderkey) AS text FROM orders""")
def text_decoding(spark, sf_dir):
    """Text files that are not clean UTF-8: each malformed sequence is one replacement character, the rest is read."""
    o = table(spark, sf_dir, "orders")
    hexed = F.element_at(F.array(*(F.lit(h) for h, _ in _BYTES)), (F.col("o_orderkey") % len(_BYTES) + 1).cast("int"))
    content = F.concat(F.unhex(hexed), F.concat(F.lit("|"), F.col("o_orderkey").cast("string")).cast("binary"))
    return o.select("o_orderkey", T.decoded(content).alias("text"))


@query("""SELECT o_orderkey, 'p' AS kind, 0 AS ord, NULL::INTEGER AS "table", NULL::INTEGER AS "row", concat('标题', o_orderkey) AS cells, 'OK' AS status FROM orders
UNION ALL SELECT o_orderkey, 'tr', 1, 1, 0, '项目|数值|数值', 'OK' FROM orders UNION ALL SELECT o_orderkey, 'tr', 1, 1, 1, concat('甲|', o_custkey, '|', o_custkey), 'OK' FROM orders UNION ALL SELECT o_orderkey, 'p', 2, NULL, NULL, 'A&B 末段', 'OK' FROM orders""")
def word_reader(spark, sf_dir):
    """Paragraphs and table rows of composed word files, cells over two columns counted in both."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", composed.word_files(F.concat(F.lit("标题"), F.col("o_orderkey").cast("string")), F.col("o_custkey").cast("string")).alias("content"))
    return files.read_word(o, key="o_orderkey").select("o_orderkey", "kind", "ord", "table", "row", F.array_join("cells", "|").alias("cells"), "status")


_SHEET = """r AS (SELECT p_partkey, 1 AS "row", ['价目', '价目', '价目'] AS cells, 'TTT' AS kinds FROM part UNION ALL SELECT p_partkey, 2, [replace(p_name, '&', '+'), p_size::VARCHAR, concat(p_size % 90, '.5')], 'TNN' FROM part
UNION ALL SELECT p_partkey, 3, ['', '', ''], '___' FROM part UNION ALL SELECT p_partkey, 4, ['1,234%', 'True', ''], 'NN_' FROM part UNION ALL SELECT p_partkey, 5, ['2020-01-02 00:00:00', '注', ''], 'TT_' FROM part)"""


@query(f"""WITH {_SHEET} SELECT p_partkey, 'S' AS sheet_name, "row"::INTEGER AS "row", array_to_string(cells, '|') AS cells, kinds FROM r""")
def sheet_reader(spark, sf_dir):
    """Cells of composed spreadsheets: merged ranges filled; numbers, flags, dates and text typed."""
    r = files.read_sheets(_sheet_files(spark, sf_dir), key="p_partkey")
    return r.select("p_partkey", "sheet_name", "row", F.array_join("cells", "|").alias("cells"), F.array_join("kinds", "").alias("kinds"))


@query(f"""WITH {_SHEET} SELECT p_partkey, string_agg(array_to_string(list_filter(cells, lambda c: c <> ''), '|'), chr(10) ORDER BY "row") AS body FROM r GROUP BY 1""")
def sheet_bodies(spark, sf_dir):
    """The text of whole spreadsheets."""
    return files.sheet_body(files.read_sheets(_sheet_files(spark, sf_dir), key="p_partkey"), key="p_partkey").select("p_partkey", "body")


def _sheet_files(spark, sf_dir):
    p = spread(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"), "p_partkey")
    return p.select("p_partkey", composed.sheet_files(F.translate("p_name", "&", "+"), F.col("p_size")).alias("content"))
