"""An inverted-file index of vectors: cells around learned directions, of which a question opens the nearest only.

Spark's k-means learns the directions from a bounded sample of vectors of unit length; every vector is then filed under
its nearest direction and the table written by cell, so a filter on cells prunes directories before a file is opened.
Vectors in the opened cells are compared exactly, so with all cells open the answer is that of dense.top_k.

Cells are rewritten one by one: upsert() and delete() touch those that hold the keys, or take the new vectors, alone.
Vectors that are null, zero, of another length than most, or hold a null or a non-finite number have no cell and no
neighbours.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexquarry.operators.dense import BLOCK, matrix, nearest, ranked, slices

#: Vectors a cell that directions are learned from, and the most cells: their centres are held by every task.
SAMPLE_A_CELL, MOST_CELLS = 256, 4096


def _width(vectors: DataFrame) -> int:
    """The commonest length of the vectors."""
    most = vectors.where("size(embedding) > 0").groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return most["n"] if most else 0


def learn(vectors: DataFrame, *, cells: int | None = None, rounds: int = 10, seed: int = 7) -> np.ndarray:
    """Directions (unit vectors, a row each) of about so many cells; by default the square root of the number of vectors."""
    width = _width(vectors)
    good = (F.size("embedding") == width) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    good = vectors.where(good).select(F.col("embedding").cast("array<double>").alias("embedding"))
    n = good.count()
    if not n:
        return np.zeros((0, width))
    cells = max(1, min(MOST_CELLS, n, round(n**0.5) if cells is None else cells))
    if cells == 1:
        return good.limit(1).toPandas()["embedding"].map(np.array).pipe(lambda s: _unit(np.stack(s)))
    share = max(1, min(1 << 20, SAMPLE_A_CELL * cells * (1 << 20) // n))
    drawn = good.where(F.pmod(F.xxhash64("embedding"), F.lit(1 << 20)) < share).select(array_to_vector("embedding").alias("features"))
    if drawn.isEmpty():
        drawn = good.select(array_to_vector("embedding").alias("features"))
    model = KMeans(k=cells, maxIter=rounds, seed=seed, distanceMeasure="cosine").fit(drawn)
    return _unit(np.stack(model.clusterCenters()))


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(axis=1))[:, None]
    return x / np.where(norm > 0, norm, 1)


def assign(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """vectors with the cell of each, null if it has none."""

    def run(batches):
        for batch in slices(batches, max(centres.shape)):
            m, rows = matrix(batch.column(batch.schema.get_field_index("embedding")), centres.shape[1])
            cell = np.full(batch.num_rows, -1, np.int32)
            if len(rows) and len(centres):
                cell[rows] = np.argmax(m @ centres.T, axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, mask=cell < 0)], [*batch.schema.names, "cell"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema)
    return vectors.mapInArrow(run, f"{kinds}, cell int")


class Index:
    """vectors: key, embedding, cell and what else they carry; centres: a direction a cell."""

    def __init__(self, vectors: DataFrame, centres: np.ndarray, key: str, folder: str | None = None):
        self.vectors, self.centres, self.key, self.folder = vectors, centres, key, folder

    def save(self, folder: str) -> None:
        """Writes the vectors by cell. A cell of many vectors is split over several files."""
        _write(self.vectors, f"{folder}/cells")
        spark = self.vectors.sparkSession
        spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(self.centres)], "cell int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{folder}/centres")

    @staticmethod
    def load(spark: SparkSession, folder: str, *, key: str = "vec_id") -> Index:
        rows = spark.read.parquet(f"{folder}/centres").orderBy("cell").collect()  # MOST_CELLS at most
        centres = np.array([r["centre"] for r in rows], np.float64).reshape(len(rows), -1)
        return Index(spark.read.parquet(f"{folder}/cells"), centres, key, folder)

    def opened(self, cells: list[int]) -> DataFrame:
        """Vectors of the given cells: of a saved index, only their directories are read."""
        return self.vectors.where(F.col("cell").isin(cells)) if len(cells) < len(self.centres) else self.vectors.where("cell is not null")

    def top_k(self, questions: DataFrame, *, k: int = 5, nprobe: int | None = None, latest_only: bool = False) -> DataFrame:
        """As dense.top_k, among the vectors of each question's nprobe nearest cells (by default an eighth of all)."""
        n = len(self.centres)
        nprobe = max(1, n // 8) if nprobe is None else max(1, min(nprobe, n))
        blocks = max(1, -(-questions.count() // BLOCK))
        every = None
        for i in range(blocks):
            rows = questions.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == i).select("qid", "embedding").collect()  # about BLOCK of them
            q, at = matrix(pa.array([r["embedding"] for r in rows], pa.list_(pa.float64())), self.centres.shape[1])
            ids = [rows[j]["qid"] for j in at]
            probes = np.zeros((len(q), n), bool)
            if len(q) and n:
                near = np.argpartition(-(q @ self.centres.T), nprobe - 1, axis=1)[:, :nprobe]
                np.put_along_axis(probes, near, True, axis=1)
            vectors = self.opened(np.flatnonzero(probes.any(axis=0)).tolist())
            each = nearest(vectors.where("is_latest = 1") if latest_only else vectors, ids, q, questions.schema["qid"], key=self.key, k=k, probes=probes)
            every = each if every is None else every.unionByName(each)
        return ranked(every, self.key, k)

    def upsert(self, more: DataFrame) -> None:
        """Replaces or adds vectors (the columns of the index, without their cell) of a saved index."""
        self._change(more.select(self.key), assign(more, self.centres))

    def delete(self, gone: DataFrame) -> None:
        """Removes the vectors of the given keys from a saved index."""
        self._change(gone.select(self.key), None)

    def _change(self, keys: DataFrame, more: DataFrame | None) -> None:
        spark = self.vectors.sparkSession
        keys = keys.distinct()
        had = {r["cell"] for r in self.vectors.select(self.key, "cell").join(keys, self.key, "left_semi").select("cell").distinct().collect()}
        gets = {r["cell"] for r in more.select("cell").distinct().collect()} if more is not None else set()
        of = lambda cells: F.col("cell").isin([c for c in cells if c is not None]) | (F.col("cell").isNull() if None in cells else F.lit(False))
        left = self.vectors.where(of(had | gets)).join(keys, self.key, "left_anti")
        stays = {r["cell"] for r in left.select("cell").distinct().collect()} | gets
        _write(left if more is None else left.unionByName(more), f"{self.folder}/cells", only_these=True)
        for cell in had - stays:  # no row of it was written over it
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/cells/cell={'__HIVE_DEFAULT_PARTITION__' if cell is None else cell}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        self.vectors = spark.read.schema(self.vectors.schema).parquet(f"{self.folder}/cells")


def _write(vectors: DataFrame, path: str, only_these: bool = False) -> None:
    writer = vectors.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell")
    writer.option("partitionOverwriteMode", "dynamic" if only_these else "static").parquet(path)


def build(vectors: DataFrame, *, key: str = "vec_id", cells: int | None = None) -> Index:
    """vectors: key, embedding, and what else should be filed with them."""
    centres = learn(vectors, cells=cells)
    return Index(assign(vectors, centres), centres, key)
