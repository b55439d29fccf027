"""A saved BM25 index whose postings stand in blocks, so that what can't reach the top k is never opened.

A term's postings are ordered by weight and cut into blocks, a row each, with the greatest weight it holds. The blocks
are a table bucketed by term (and by part, so that a common term fills several buckets): questions are brought to it,
and it is not shuffled. The documents' own tokens are kept in order of their document, to score candidates exactly.

A batch of questions is answered in two passes. The first opens the best blocks of each question's heaviest terms and
scores the best chunks found there in full; the k-th best is a bound that the answer's scores can't be below. Then blocks are closed whose weights, with
the greatest closed one of each term, stay under the bound together: the lightest terms, or the light blocks of all,
whichever leaves fewer rows. A chunk that reaches the bound is in an open block; those that still can are scored in full. Results are those of
bm25.retrieve.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexquarry.functions.text import tokens
from lexquarry.operators import bm25
from lexquarry.session import kept, stored

#: Postings of a block, parts that a term's blocks are dealt to, and terms of a question whose best block sets its bound.
BLOCK, PARTS, SEEDS = 512, 8, 8
#: Tokens that a task sorts postings of, and that are counted at a time.
SORTED, COUNTED = 500_000, 1_000_000


def _weight(k1: float, b: float, avgdl: float):
    return F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(avgdl or 1.0)))


def _few(df: DataFrame) -> DataFrame:
    """df, computed once, and broadcast if it is small: what stands in blocks and tokens is then not shuffled to meet it."""
    df = kept(df)
    return F.broadcast(df) if df.count() <= bm25.BROADCAST_TERMS else df


def _counted(title_weight: int):
    """For mapInArrow over CARRIED, terms and title_terms: CARRIED, term and tf of each chunk's terms."""
    fields, lists = list(bm25.CARRIED), ("terms", "title_terms")

    def tallied(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, weights = [], []
        for name, w in zip(lists, (1, title_weight), strict=True):
            row.append(np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(batch.column(name)), 0).to_numpy(zero_copy_only=False)))
            weights.append(np.full(len(row[-1]), w, np.int64))
        term = pa.concat_arrays([batch.column(name).flatten() for name in lists]).dictionary_encode(null_encoding="encode")
        many = max(1, len(term.dictionary))
        key, which = np.unique(np.concatenate(row) * many + term.indices.to_numpy(zero_copy_only=False), return_inverse=True)
        tf = np.bincount(which, np.concatenate(weights), len(key)).astype(np.int64)
        carried = batch.select(fields).take(pa.array(key // many))
        return pa.RecordBatch.from_arrays([*carried.columns, term.dictionary.take(pa.array(key % many)), pa.array(tf)], [*fields, "term", "tf"])

    def run(batches):
        for batch in batches:
            n = sum(pc.sum(pc.list_value_length(batch.column(c))).as_py() or 0 for c in lists)
            size = max(1, batch.num_rows * COUNTED // max(COUNTED, n))
            for at in range(0, batch.num_rows, size):
                yield tallied(batch.slice(at, size))

    return run


def _postings(chunks: DataFrame, title_weight: int) -> DataFrame:
    """bm25.Index.postings() of all terms, counted where the chunks lie. Only chunks that agree in all of CARRIED, whose terms count together, are shuffled."""
    kind = {f.name: f.dataType.simpleString() for f in chunks.schema}
    fields = ", ".join(f"{c} {kind[c]}" for c in bm25.CARRIED)
    each = chunks.select(*bm25.CARRIED, "terms", "title_terms").mapInArrow(_counted(title_weight), f"{fields}, term string, tf long")
    together = lambda df: df.groupBy(*bm25.CARRIED, "term").agg(F.sum("tf").alias("tf"))
    mark = F.xxhash64(*bm25.CARRIED).alias("_mark")
    again = kept(chunks.groupBy(mark).count().where("count > 1").select("_mark"))
    n = again.count()
    if n > bm25.BROADCAST_TERMS:
        return together(each)
    if not n:
        return each
    marked = each.select("*", mark)
    return marked.join(F.broadcast(again), "_mark", "left_anti").drop("_mark").unionByName(together(marked.join(F.broadcast(again), "_mark", "left_semi")))


def _blocked(block: int):
    """For mapInArrow over (term, w, postings' fields) sorted by term and falling weight: runs of a term as rows of lists."""

    def rows(table: pa.Table, first: np.ndarray, number: int) -> pa.RecordBatch:
        bounds = pa.array(np.append(first, table.num_rows).astype(np.int32))
        posting = table.drop(["term", "w"]).to_struct_array().combine_chunks() if table.num_columns > 2 else None
        at = pa.array(first)
        serial = number + np.arange(len(first))
        columns = [table["term"].combine_chunks().take(at), pa.array((serial % PARTS).astype(np.int32)), pa.array(serial), pa.array(np.diff(bounds.to_numpy()).astype(np.int64)), table["w"].combine_chunks().take(at), pa.ListArray.from_arrays(bounds, posting)]
        return pa.RecordBatch.from_arrays(columns, ["term", "part", "block", "n", "w", "postings"])

    def starts(table: pa.Table) -> np.ndarray:
        """Where blocks begin: at each term, and after each `block` rows of one."""
        code = table["term"].combine_chunks().dictionary_encode().indices.to_numpy()
        new = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
        place = np.arange(len(code)) - np.repeat(new, np.diff(np.append(new, len(code))))
        return np.flatnonzero(place % block == 0)

    def run(batches):
        from pyspark import TaskContext

        number, held, n = TaskContext.get().partitionId() << 40, [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= 4 * block:
                table = pa.Table.from_batches(held)
                first = starts(table)
                if len(first) > 1:  # the last may go on
                    yield rows(table.slice(0, int(first[-1])), first[:-1], number)
                    number += len(first) - 1
                    table = table.slice(int(first[-1])).combine_chunks()
                held, n = table.to_batches(), table.num_rows
        if n:
            table = pa.Table.from_batches(held)
            yield rows(table, starts(table), number)

    return run


class Index:
    """chunks: the chunks' fields and tokens; blocks: (term, part, block, n, w, postings); stats: N, avgdl, k1, b, title_weight; rows: doc_id, n_rows; cut: CARRIED and tokens of the chunks where they stand apart."""

    def __init__(self, chunks: DataFrame, blocks: DataFrame, stats: dict, rows: DataFrame, tokenizer=tokens, cut: DataFrame | None = None):
        self.chunks, self.blocks, self.stats, self.rows, self.tokenizer = chunks, blocks, stats, rows, tokenizer
        self.cut = chunks.select(*bm25.CARRIED, "terms", "title_terms") if cut is None else cut

    def kept(self) -> Index:
        """The same, computed once, for use without a folder of its own. Tokens are in files already; the chunks' other fields stay where they come from."""
        return Index(self.chunks, stored(self.blocks), self.stats, self.rows, self.tokenizer, self.cut)

    def save(self, folder: str, *, buckets: int = 32) -> None:
        """Files under the folder; the bucketed table is registered in the session's catalog by its place."""
        spark = self.chunks.sparkSession
        by_doc = lambda df: df.repartitionByRange("doc_id").sortWithinPartitions("doc_id").write.mode("overwrite")
        by_doc(self.chunks).parquet(f"{folder}/chunks")
        by_doc(self.rows).parquet(f"{folder}/rows")
        spark.createDataFrame([{**self.stats, "buckets": buckets}]).coalesce(1).write.mode("overwrite").parquet(f"{folder}/stats")
        spark.sql(f"DROP TABLE IF EXISTS {_name(folder)}")
        blocks = self.blocks.repartition(buckets, "term", "part")
        blocks.write.mode("overwrite").bucketBy(buckets, "term", "part").sortBy("term", "part").option("path", f"{folder}/blocks").format("parquet").saveAsTable(_name(folder))

    @staticmethod
    def load(spark: SparkSession, folder: str, *, tokenizer=tokens) -> Index:
        stats = spark.read.parquet(f"{folder}/stats").first().asDict()
        plain = spark.read.parquet(f"{folder}/blocks")
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema)
        spark.sql(f"DROP TABLE IF EXISTS {_name(folder)}")
        spark.sql(f"CREATE TABLE {_name(folder)} ({fields}) USING parquet CLUSTERED BY (term, part) SORTED BY (term, part) INTO {stats.pop('buckets')} BUCKETS LOCATION '{folder}/blocks'")
        return Index(spark.read.parquet(f"{folder}/chunks"), spark.table(_name(folder)), stats, spark.read.parquet(f"{folder}/rows"), tokenizer)

    def retrieve(self, questions: DataFrame, *, k: int = 5, drilldown: bool = True) -> DataFrame:
        """As bm25.retrieve."""
        old = F.col("include_history") if "include_history" in questions.columns else F.lit(False)
        history = questions.select("qid", F.coalesce(old, F.lit(False)).alias("include_history"))
        asked = bm25.question_terms(questions, tokenizer=self.tokenizer)
        few = asked.count() * PARTS <= bm25.BROADCAST_TERMS
        mark = F.broadcast if few else (lambda d: d)
        met = kept(self._asked_blocks(asked))
        asked = self._known(asked, met)
        chosen, bounds = self.opened(asked, history, k=k, met=met)
        chosen, bounds = _few(chosen), kept(bounds)
        partial = self._scored(chosen).groupBy("qid", "chunk_ix", "doc_id", "is_latest").agg(F.sum("s").alias("s"))
        could = partial.join(mark(bounds), "qid").join(mark(history), "qid").where("(include_history or is_latest <> 0) and s + rest >= bound - 1e-6")
        found = kept(self.exact(asked, could.select("qid", "chunk_ix", "doc_id"), pairs=True))

        def of_documents(table: DataFrame) -> DataFrame:
            return self.exact(asked, table, pairs=False)

        return bm25.placed(self.chunks, self.rows, found, of_documents, k=k, drilldown=drilldown, few=few)

    def _asked_blocks(self, asked: DataFrame) -> DataFrame:
        """Each question's blocks (without their postings), with the most that a chunk in it can get by them."""
        each = asked.select("qid", "term", "qtf", F.explode(F.array(*(F.lit(i) for i in range(PARTS)))).alias("part"))
        few = F.broadcast(each) if asked.count() * PARTS <= bm25.BROADCAST_TERMS else each
        met = self.blocks.select("term", "part", "block", "n", "w").join(few, ["term", "part"])
        df = met.groupBy("qid", "term").agg(F.sum("n").alias("df"))
        factor = F.col("qtf") * F.log(1 + (self.stats["N"] - F.col("df") + 0.5) / (F.col("df") + 0.5))
        return met.join(df, ["qid", "term"]).withColumn("factor", factor).withColumn("c", factor * F.col("w"))

    @staticmethod
    def _known(asked: DataFrame, met: DataFrame) -> DataFrame:
        """asked with the df of each term (of those that any chunk has), from each question's blocks."""
        return _few(asked.join(met.groupBy("qid", "term").agg(F.sum("n").alias("df")), ["qid", "term"]))

    def _scored(self, chosen: DataFrame) -> DataFrame:
        """qid, a posting's fields and what it adds to the question's score, of the chosen blocks (qid, term, part, block, factor)."""
        met = self.blocks.select("term", "part", "block", "postings").join(chosen, ["term", "part", "block"])
        each = met.select("qid", "factor", F.inline("postings"))
        return each.withColumn("s", F.col("factor") * _weight(self.stats["k1"], self.stats["b"], self.stats["avgdl"]))

    def opened(self, asked: DataFrame, history: DataFrame, *, k: int = 5, met: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """The blocks that each question must open (qid, term, part, block, n, factor), and its bounds: qid, bound (of the k-th score) and rest (the most that the closed blocks give). met: _asked_blocks(), with asked as _known()."""
        if met is None:
            met = kept(self._asked_blocks(asked))
            asked = self._known(asked, met)
        heaviest = met.groupBy("qid", "term").agg(F.max(F.struct("c", "part", "block", "factor")).alias("top"))
        by_weight = Window.partitionBy("qid").orderBy(F.desc("top.c"), "term")
        seeds = heaviest.withColumn("r", F.row_number().over(by_weight)).where(F.col("r") <= SEEDS).select("qid", "term", "top.part", "top.block", "top.factor")
        first = self._scored(_few(seeds)).groupBy("qid", "chunk_ix", "doc_id", "is_latest").agg(F.sum("s").alias("s")).join(history, "qid").where("include_history or is_latest <> 0")
        first = first.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("s"), "chunk_ix"))).where(F.col("r") <= 4 * k)
        # in full, those chunks have the k-th score or a bound close below it
        first = self.exact(asked, first.select("qid", "chunk_ix", "doc_id"), pairs=True)
        kth = first.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score")))).where(F.col("r") == k).select("qid", F.col("score").alias("bound"))
        terms = met.groupBy("qid", "term").agg(F.max("c").alias("u"), F.sum("n").alias("df")).join(kth, "qid", "left").withColumn("bound", F.greatest(F.coalesce("bound", F.lit(0.0)) - 2e-6, F.lit(0.0)))
        # three ways to share the bound out; a block stays closed if what it can give is below its term's share
        light = Window.partitionBy("qid").orderBy("u", "term").rowsBetween(Window.unboundedPreceding, -1)
        of_all, long = Window.partitionBy("qid"), F.col("df") > 2 * BLOCK
        before = lambda of: F.coalesce(F.sum(F.when(of, F.col("u"))).over(light), F.lit(0.0))
        left_over = lambda of: F.count(F.when(of, 1)).over(of_all) - F.count(F.when(of, 1)).over(light)
        all_ = F.lit(True)
        terms = terms.select("*", (F.col("bound") - before(all_)).alias("r1"), ((F.col("bound") - before(all_)) / left_over(all_)).alias("x2"), F.when(long, (F.col("bound") - before(long)) / left_over(long)).alias("x3"))
        # the lightest terms whole and a part of the next; the same level for all terms; the same level for the terms of many blocks
        level = lambda x, of: F.when(of, F.least(F.max(x).over(of_all), F.max(F.when(of, F.col("u"))).over(of_all)))
        rooms = F.array(*(F.greatest(F.coalesce(r, F.lit(0.0)), F.lit(0.0)) for r in (F.col("r1"), level("x2", all_), level("x3", long))))
        terms = terms.select("qid", "term", "bound", rooms.alias("rooms"))
        every = met.join(terms, ["qid", "term"])
        cost = lambda i: F.sum(F.when(F.col("c") >= F.col("rooms")[i] - 1e-9, F.col("n")).otherwise(0))
        best = every.groupBy("qid").agg(F.array_min(F.array(*(F.struct(cost(i).alias("rows"), F.lit(i).alias("way")) for i in range(3))))["way"].alias("way"))
        every = every.join(best, "qid").withColumn("open", F.col("c") >= F.element_at("rooms", F.col("way") + 1) - 1e-9)
        left = every.groupBy("qid", "term").agg(F.max("bound").alias("bound"), F.coalesce(F.max(F.when(~F.col("open"), F.col("c"))), F.lit(0.0)).alias("rest"))
        return every.where("open").select("qid", "term", "part", "block", "n", "factor"), left.groupBy("qid").agg(F.max("bound").alias("bound"), F.sum("rest").alias("rest"))

    def exact(self, asked: DataFrame, wanted: DataFrame, *, pairs: bool) -> DataFrame:
        """Full scores of chunks. asked: as _known(). wanted: qid, doc_id and chunk_ix (pairs), or the documents whose rows of tables are asked for."""
        wanted, on = (kept(wanted), ["doc_id", "chunk_ix"]) if pairs else (kept(wanted.select("qid", "doc_id").distinct()), ["doc_id"])
        found = self.cut if pairs else self.cut.where("is_row")
        weighted = lambda c, w: F.transform(c, lambda t: F.struct(t.alias("term"), F.lit(w).cast("long").alias("w")))
        token = F.explode(F.concat(weighted("terms", 1), weighted("title_terms", self.stats["title_weight"]))).alias("t")
        if wanted.count() <= bm25.BROADCAST_TERMS:
            each = found.join(F.broadcast(wanted), on).select("qid", *bm25.CARRIED, token).select("qid", *bm25.CARRIED, "t.*")
        else:  # of the tokens only those that are asked for are shuffled
            each = found.select(*bm25.CARRIED, token).select(*bm25.CARRIED, "t.*").join(_few(asked.select("term").distinct()), "term", "left_semi").join(wanted, on)
        tf = each.join(asked, ["qid", "term"]).groupBy("qid", *bm25.CARRIED, "term", "qtf", "first_at", "df").agg(F.sum("w").alias("tf"))
        one = bm25.weight(F.col("tf"), F.col("df"), F.col("dl"), F.lit(self.stats["N"]), F.lit(self.stats["avgdl"]), self.stats["k1"], self.stats["b"])
        return tf.groupBy("qid", *bm25.CARRIED).agg(F.round(F.sum(F.col("qtf") * one), 6).alias("score"), F.min("first_at").alias("first_at"))


def _name(folder: str) -> str:
    return "lexquarry_blocks_" + hashlib.sha1(folder.encode()).hexdigest()[:16]


def build(index: bm25.Index, *, k1: float = 1.6, b: float = 0.75, block: int = BLOCK) -> Index:
    """Blocks of an index that bm25.build() made. Its chunks are cut into tokens once, and those are stored."""
    cut = stored(index.chunks.select(*bm25.CARRIED, "terms", "title_terms"))
    figures, rows = bm25._figures(cut)
    row = figures.first()
    stats = {"N": row["N"], "avgdl": row["avgdl"], "k1": k1, "b": b, "title_weight": index.title_weight}
    # what varies most stands last: rows of a shuffle compress better so
    postings = _postings(cut, index.title_weight).select("is_latest", "tf", "chunk_ix", "dl", "doc_id", "term")
    kind = {f.name: f.dataType.simpleString() for f in postings.schema}
    carried = ("chunk_ix", "doc_id", "is_latest", "dl", "tf")
    fields = ", ".join(f"{c}: {kind[c]}" for c in carried)
    # a common term may fill many partitions: the order is by range; weights are not shuffled but computed again
    tasks = max(cut.sparkSession.sparkContext.defaultParallelism, int(row["N"] * row["avgdl"] // SORTED))
    w = _weight(k1, b, row["avgdl"])
    ordered = postings.repartitionByRange(tasks, "term", w.desc(), "chunk_ix").select("term", w.alias("w"), *carried).sortWithinPartitions("term", F.desc("w"), "chunk_ix")
    blocks = ordered.mapInArrow(_blocked(block), f"term string, part int, block long, n long, w double, postings array<struct<{fields}>>")
    return Index(index.chunks, blocks, stats, rows, index.tokenizer, cut)
