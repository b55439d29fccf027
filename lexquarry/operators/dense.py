"""Dense retrieval: cosine similarity of vectors, exact, for a set of questions in blocks; upsert and delete by key.

A block of questions is one matrix in every task; a batch of vectors is multiplied with it, and each task keeps its
best k a question, so only those are shuffled.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Question vectors held by one pass over the vectors (16 MB of a thousand numbers each); more are further passes.
BLOCK = 2_000
#: Scores that a task computes at a time (8 MB), whatever the sizes of batches and cells.
SCORES = 1 << 20


#: Models by their Lazy's key, in this process.
_MODELS: dict[str, Callable] = {}


class Lazy:
    """A model that every Python worker loads once, when it first needs it; what is sent to tasks is the loader."""

    def __init__(self, load: Callable[[], Callable[[list[str]], list[list[float]]]]):
        self.load, self.key = load, uuid.uuid4().hex

    def __call__(self, texts: list[str]) -> list[list[float]]:
        if self.key not in _MODELS:
            _MODELS.clear()  # one at a time
            _MODELS[self.key] = self.load()
        return _MODELS[self.key](texts)


def encode(df: DataFrame, model: Callable[[list[str]], list[list[float]]], text: Column, out: str = "embedding", *, size: int = 64) -> DataFrame:
    """Adds vectors by a model of the caller's (or a Lazy one), which gets so many texts of like length at a time."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            order = np.argsort([len(t) if t is not None else 0 for t in texts], kind="stable")
            vectors = np.empty(len(texts), object)
            for at in range(0, len(order), size):
                own = order[at : at + size]
                for i, v in zip(own, model(texts.iloc[own].tolist()), strict=True):
                    vectors[i] = v
            yield pd.Series(vectors)

    return df.withColumn(out, run(text))


def document_text(title: Column, text: Column) -> Column:
    return F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), text)


def question_text(question: Column) -> Column:
    return F.concat(F.lit("为这个句子生成表示以用于检索相关文章："), question)  # fixed value


def matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of unit length, and their places: those that are finite, neither null nor zero, and of this width."""
    rows = np.flatnonzero(pc.equal(pc.fill_null(pc.list_value_length(column), -1), width).to_numpy(zero_copy_only=False)) if width else np.zeros(0, np.int64)
    m = pc.fill_null(column.take(pa.array(rows)).flatten(), 0).to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), width)
    norm = np.sqrt((m * m).sum(axis=1))
    good = (norm > 0) & np.isfinite(norm)
    return m[good] / norm[good][:, None], rows[good]


def slices(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of SCORES numbers at most, for rows of so many."""
    size = max(1, SCORES // max(1, width))
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


def _met(cells: np.ndarray, probes: np.ndarray):
    """(questions, rows) that meet: the rows of a cell and the questions that open it."""
    order = np.argsort(cells, kind="stable")
    for here in np.split(order, np.flatnonzero(np.diff(cells[order])) + 1):
        own = np.flatnonzero(probes[:, cells[here[0]]])
        if len(own):
            yield own, here


def _pieces(own: np.ndarray, here: np.ndarray):
    """The same pairs in pieces of at most SCORES (of one row, if there are more questions than that)."""
    size = max(1, SCORES // len(own))
    for at in range(0, len(here), size):
        yield own, here[at : at + size]


def _order(keys: pa.Array) -> np.ndarray:
    """The place of each key in Spark's order; equal keys share one. Structs, which Arrow can't rank, go by their fields."""
    if not pa.types.is_struct(keys.type):
        return pc.rank(keys, "ascending", null_placement="at_start", tiebreaker="dense").to_numpy()
    fields = [pc.is_valid(keys).to_numpy(zero_copy_only=False).astype(np.int64), *map(_order, keys.flatten())]
    return np.unique(np.stack(fields, axis=1), axis=0, return_inverse=True)[1].reshape(-1)


class _Best:
    """Each question's k best scores so far, and those that rounding might put among them: question, score, key."""

    def __init__(self, questions: int, k: int):
        self.k, self.least = k, np.full(questions, -np.inf)
        self.kept: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
        self.n = self.left = 0

    def add(self, own: np.ndarray, scores: np.ndarray, keys: pa.Array) -> None:
        """scores: a row for each question of own, a column for each key."""
        least = self.least[own]
        if scores.shape[1] > self.k:
            least = np.maximum(least, np.partition(scores, -self.k, axis=1)[:, -self.k] - 1e-6)
        q, at = np.nonzero(scores >= least[:, None])
        if len(q):
            self.kept.append((own[q], scores[q, at], keys.take(pa.array(at))))
            self.n += len(q)
        if self.n > 2 * self.left + SCORES // 4:
            self.cut()

    def cut(self) -> None:
        if not self.kept:
            return
        q, score, keys = np.concatenate([x[0] for x in self.kept]), np.concatenate([x[1] for x in self.kept]), pa.concat_arrays([x[2] for x in self.kept])
        order = np.lexsort((-score, q))
        first = np.flatnonzero(np.append(True, q[order][1:] != q[order][:-1]))
        size = np.diff(np.append(first, len(order)))
        least = score[order][first + np.minimum(size, self.k) - 1] - 1e-6
        full = size >= self.k
        self.least[q[order][first[full]]] = np.maximum(self.least[q[order][first[full]]], least[full])
        best = order[score[order] >= np.repeat(least, size)]
        if len(best) > self.k * len(first):  # copies: of those that surely round alike, only the k least keys can be ranked
            q, score, keys = q[best], score[best], keys.take(pa.array(best))
            scaled = score * 1e6
            alike = np.where(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-6, scaled, np.rint(scaled))
            by = np.lexsort((_order(keys), alike, q))
            new = np.flatnonzero(np.append(True, (q[by][1:] != q[by][:-1]) | (alike[by][1:] != alike[by][:-1])))
            best = by[np.arange(len(by)) - np.repeat(new, np.diff(np.append(new, len(by)))) < self.k]
        self.kept = [(q[best], score[best], keys.take(pa.array(best)))]
        self.n = self.left = len(best)


def nearest(vectors: DataFrame, ids: list, questions: np.ndarray, qid, *, key: str, k: int, probes: np.ndarray | None = None) -> DataFrame:
    """qid, key and score of each task's k nearest vectors of each question (and of those that rounding might put among them).

    questions: vectors of unit length, of the ids. probes: which cells (of a column cell) each question opens; None: all.
    """
    if probes is not None and probes.all():
        probes = None

    def run(batches):
        best = _Best(len(questions), k)
        for batch in slices(batches, questions.shape[1]):
            m, rows = matrix(batch.column(1), questions.shape[1])
            if not len(rows) or not len(questions):
                continue
            if probes is None:
                met = [(np.arange(len(questions)), np.arange(len(rows)))]
            else:
                met = _met(batch.column(2).to_numpy(zero_copy_only=False)[rows].astype(np.int64), probes)
            for own, all_ in met:
                for own, here in _pieces(own, all_):
                    best.add(own, questions[own] @ m[here].T, batch.column(0).take(pa.array(rows[here])))
        best.cut()
        for q, score, keys in best.kept:
            yield pa.RecordBatch.from_arrays([pa.array(ids).take(pa.array(q)), keys, pa.array(score)], ["qid", key, "score"])

    columns = [key, "embedding"] if probes is None else [key, "embedding", "cell"]
    return vectors.select(*columns).mapInArrow(run, f"qid {qid.dataType.simpleString()}, `{key}` {vectors.schema[key].dataType.simpleString()}, score double")


def ranked(found: DataFrame, key: str, k: int) -> DataFrame:
    best = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), key))
    return found.withColumn("score", F.round("score", 6)).withColumn("rank", best).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, questions: DataFrame, *, k: int = 5, key: str = "vec_id", latest_only: bool = False) -> DataFrame:
    """qid, rank, key and score (cosine, six decimals) of the k nearest vectors of each question (qid, embedding).

    Vectors that are null, zero, not finite or of another length than the questions' have no neighbours.
    """
    if latest_only:
        vectors = vectors.where("is_latest = 1")
    blocks = max(1, -(-questions.count() // BLOCK))
    every = None
    for i in range(blocks):
        rows = questions.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == i).select("qid", "embedding").collect()  # about BLOCK of them
        width = max((len(r["embedding"] or ()) for r in rows), default=0)
        q, at = matrix(pa.array([r["embedding"] for r in rows], pa.list_(pa.float64())), width)
        each = nearest(vectors, [rows[j]["qid"] for j in at], q, questions.schema["qid"], key=key, k=k)
        every = each if every is None else every.unionByName(each)
    return ranked(every, key, k)


def upsert(vectors: DataFrame, more: DataFrame, *, key: str = "vec_id", ordinal: str = "batch") -> DataFrame:
    """For each key the row of the greatest ordinal (more's must exceed those that are there)."""
    both = vectors.unionByName(more)
    fields = [c for c in both.columns if c != key]
    last = both.groupBy(key).agg(F.max_by(F.struct(*fields), ordinal).alias("_last"))
    return last.select(key, *(F.col(f"_last.{c}").alias(c) for c in fields))


def delete(vectors: DataFrame, gone: DataFrame, *, key: str = "doc_id") -> DataFrame:
    return vectors.join(gone.select(key).distinct(), key, "left_anti")


class Index:
    """Chunks with their vectors. save() and load() by folder; retrieve() as operators.bm25.Index has it, but rows of tables have no say.

    filed: the vectors by cell (operators.ivf), which questions open in part; without it all vectors are compared.
    """

    def __init__(self, chunks: DataFrame, model: Callable[[list[str]], list[list[float]]], filed=None, nprobe: int | None = None):
        self.chunks, self.model, self.filed, self.nprobe = chunks, model, filed, nprobe

    def save(self, folder: str, *, cells: int | None = 0) -> None:
        """cells: how many cells to file the vectors under; None: by their number; 0: don't."""
        self.chunks.write.mode("overwrite").parquet(f"{folder}/vectors")
        if cells != 0:
            from lexquarry.operators import ivf

            rows = self.chunks.sparkSession.read.parquet(f"{folder}/vectors").select("chunk_ix", "embedding", F.coalesce("is_latest", F.lit(1)).alias("is_latest"))
            ivf.build(rows, key="chunk_ix", cells=cells).save(f"{folder}/filed")

    @staticmethod
    def load(spark: SparkSession, folder: str, model: Callable[[list[str]], list[list[float]]], *, nprobe: int | None = None) -> Index:
        """nprobe: how many cells a question opens of an index that was saved with cells; None: all vectors are compared."""
        filed = None
        if nprobe is not None:
            from lexquarry.operators import ivf

            filed = ivf.Index.load(spark, f"{folder}/filed", key="chunk_ix")
        return Index(spark.read.parquet(f"{folder}/vectors"), model, filed, nprobe)

    def retrieve(self, questions: DataFrame, *, k: int = 5, drilldown: bool = False) -> DataFrame:
        """The k nearest chunks of each question (qid, question, include_history if given), with rank, score and the chunks' fields."""
        asked = encode(questions.where("question is not null"), self.model, question_text(F.col("question"))).select("qid", "embedding", (F.coalesce("include_history", F.lit(False)) if "include_history" in questions.columns else F.lit(False)).alias("old"))
        new, old = asked.where("not old"), asked.where("old")
        if self.filed is not None:
            found = self.filed.top_k(new, k=k, nprobe=self.nprobe, latest_only=True).unionByName(self.filed.top_k(old, k=k, nprobe=self.nprobe))
        else:
            latest = self.chunks.where("coalesce(is_latest, 1) <> 0")
            found = top_k(latest, new, k=k, key="chunk_ix").unionByName(top_k(self.chunks, old, k=k, key="chunk_ix"))
        return found.join(self.chunks.drop("embedding"), "chunk_ix")


def build(chunks: DataFrame, model: Callable[[list[str]], list[list[float]]]) -> Index:
    """chunks: chunk_ix, doc_title, text, is_latest and what hits should carry."""
    return Index(encode(chunks, model, document_text(F.col("doc_title"), F.col("text"))), model)
