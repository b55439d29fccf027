"""Nearest vectors by cosine: stable projections of few dimensions in kd-trees, verified until a chi-square test stops.

Vectors of length one are projected by Gaussian (2-stable) columns: of two vectors at distance d, the projections'
squared distance over d**2 follows a chi-square law of m degrees. A query verifies vectors leaf by leaf, nearest
projection first, and stops once the next leaf's squared distance is beyond the law's quantile times that of its k-th
best so far: a vector as near as that is projected so far away with a probability of 1 - sure at most.

In Spark, the upper levels of the tree are cut from a sample and deal vectors to cells; a cell of many vectors, copies
of one for instance, is dealt on by a hash, so no task holds more than shard_bytes of them. Each query meets its own
cell first, which bounds its k-th distance, and then every cell whose box the test can't rule out; a cell's vectors
stand before its queries in one sorted stream, of which a task keeps the vectors only.

Cases. Vectors that are null, empty, zero, hold a null or a non-finite number, or are of another length than most (of
lengths equally frequent: the least) take no part. Rows that repeat an id, or are equal, are vectors of their own;
each query leaves out itself alone, and queries that repeat an id each return their neighbours. Null ids are no
queries; as neighbours they come first among ties. Scores tie if they agree to twelve decimals. Fewer candidates than
k are all returned; an empty table has no result. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType
from pyspark.sql.window import Window

from lexquarry.llm.spark import cut, prepare

#: Dimensions of the projection (even), and the law's quantile at which a query stops.
DIMENSIONS, SURE = 12, 0.97
#: Rows that the upper levels are cut from, how many levels, and rows of a leaf of a cell's own tree.
SAMPLE, LEVELS, LEAF = 16_384, 6, 64
#: Bytes of vectors that a task holds.
SHARD_BYTES = 32 << 20


def chi_square_quantile(sure: float, m: int) -> float:
    """Where the chi-square law of m degrees (even) has the probability sure below it."""
    below = lambda x: 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(m // 2))
    low, high = 0.0, 1.0
    while below(high) < sure:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < sure else (low, middle)
    return high


def projection(width: int, m: int) -> np.ndarray:
    return np.random.default_rng(20).standard_normal((width, m))


def _lists(column: pa.Array, width: int) -> np.ndarray:
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of each row of x with the same row of y."""
    x, y = (a / np.abs(a).max(axis=1, keepdims=True) for a in (x, y))
    return (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))


def _whole(batches):
    """Rows whose vectors take part, with the vectors' lengths."""
    for batch in batches:
        column = batch.column(1)
        n = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = pc.fill_null(pc.list_flatten(column), float("nan")).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(n)), n)
        odd = np.bincount(row, ~np.isfinite(flat), len(n))
        some = np.bincount(row, np.nan_to_num(flat) != 0, len(n))
        keep = pa.array((n > 0) & (odd == 0) & (some > 0))
        yield pa.RecordBatch.from_arrays([*(c.filter(keep) for c in batch.columns), pa.array(n).filter(keep)], [*batch.schema.names, "width"])


class Cells:
    """The upper levels: a complete binary tree of (dimension, threshold), cut at medians of a sample."""

    def __init__(self, sample: np.ndarray, levels: int):
        self.levels = levels
        self.dim, self.cut = np.zeros((1 << levels) - 1, np.int64), np.zeros((1 << levels) - 1)
        parts = [sample]
        for i in range(len(self.dim)):
            part = parts[i]
            if len(part):
                self.dim[i] = d = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
                self.cut[i] = np.median(part[:, d])
            left = part[:, self.dim[i]] < self.cut[i]
            parts += [part[left], part[~left]]

    def of(self, points: np.ndarray) -> np.ndarray:
        at = np.zeros(len(points), np.int64)
        for _ in range(self.levels):
            at = 2 * at + 1 + (points[np.arange(len(points)), self.dim[at]] >= self.cut[at])
        return at - len(self.dim)


class Tree:
    """A kd-tree over the projections of a cell's vectors: a complete binary tree, halved by rank, with the box of every node."""

    def __init__(self, points: np.ndarray):
        self.levels = max(0, math.ceil(math.log2(max(1, len(points)) / LEAF)))
        parts = [np.arange(len(points))]
        for _ in range(self.levels):
            halves = []
            for part in parts:
                p = points[part]
                d = int(np.argmax(p.max(axis=0) - p.min(axis=0)))
                half = np.argpartition(p[:, d], len(part) // 2)
                halves += [part[half[: len(part) // 2]], part[half[len(part) // 2 :]]]
            parts = halves
        self.leaves = parts
        self.low = [np.array([points[p].min(axis=0) for p in parts])]
        self.high = [np.array([points[p].max(axis=0) for p in parts])]
        for _ in range(self.levels):
            self.low.insert(0, np.minimum(self.low[0][::2], self.low[0][1::2]))
            self.high.insert(0, np.maximum(self.high[0][::2], self.high[0][1::2]))

    def reached(self, points: np.ndarray, radius2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, leaf, squared distance) of leaves within each query's radius, by query, nearest first."""
        q, node = np.arange(len(points)), np.zeros(len(points), np.int64)
        for level in range(self.levels + 1):
            if level:
                q, node = np.repeat(q, 2), np.stack([2 * node, 2 * node + 1], axis=1).ravel()
            far2 = box_distance2(points[q], self.low[level][node], self.high[level][node])
            near = far2 <= radius2[q]
            q, node, far2 = q[near], node[near], far2[near]
        order = np.lexsort((far2, q))
        return q[order], node[order], far2[order]


def box_distance2(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    off = np.maximum(np.maximum(low - points, points - high), 0)
    return (off * off).sum(axis=-1)


class Shard:
    def __init__(self, rows: pa.Table, width: int, m: int, k: int, stop: float):
        self.row, self.ids = rows["row"].to_numpy(), rows["vec_id"].combine_chunks()
        self.raw = _lists(rows["v"].combine_chunks(), width)
        self.unit = _unit(self.raw)
        self.g, self.k, self.stop = projection(width, m), k, stop
        self.tree = Tree(self.unit @ self.g)
        # how ids are ordered among ties
        self.rank = np.empty(len(self.row), np.int64)
        self.rank[pc.sort_indices(self.ids, null_placement="at_start").to_numpy()] = np.arange(len(self.row))

    def search(self, row: np.ndarray, raw: np.ndarray, bound2: np.ndarray):
        """(query, place, score) of the k nearest of each query found here, and the squared distance of each k-th."""
        unit = _unit(raw)
        q, leaf, far2 = self.tree.reached(unit @ self.g, self.stop * bound2 + 1e-9)
        first = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, np.int64)
        rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        bound2, done, step = bound2.copy(), 0, 1
        bq, bp, bs = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        while True:
            # the next leaves of every query, twice as many each time, unless the test stops it
            now = np.flatnonzero((rank >= done) & (rank < done + step) & (far2 <= self.stop * bound2[q] + 1e-9))
            if not len(now):
                break
            now = now[np.argsort(leaf[now], kind="stable")]
            found = [(bq, bp, bs)]
            for part in np.split(now, np.flatnonzero(np.diff(leaf[now])) + 1):
                own, places = q[part], self.tree.leaves[leaf[part[0]]]
                score = unit[own] @ self.unit[places].T
                least = 1 - bound2[own] / 2 - 1e-9
                i, j = np.nonzero((score >= least[:, None]) & (row[own][:, None] != self.row[places][None]))
                found.append((own[i], places[j], score[i, j]))
            bq, bp, bs = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((self.rank[bp], -np.round(bs, 12), bq))
            bq, bp, bs = bq[order], bp[order], bs[order]
            first = np.flatnonzero(np.append(True, bq[1:] != bq[:-1])) if len(bq) else np.zeros(0, np.int64)
            at = np.arange(len(bq)) - np.repeat(first, np.diff(np.append(first, len(bq))))
            last = at == self.k - 1
            bound2[bq[last]] = np.minimum(bound2[bq[last]], np.maximum(0, 2 - 2 * bs[last]))
            bq, bp, bs = (x[at < self.k] for x in (bq, bp, bs))
            done, step = done + step, 2 * step
        return bq, bp, cosines(raw[bq], self.raw[bp]), bound2


def _stream(width: int, m: int, k: int, stop: float, answer):
    """For mapInArrow over (shard, asks, row, vec_id, v, bound2), a shard's vectors before its queries: answer(shard, queries) of every batch of queries."""

    def run(batches):
        now, held, shard = None, [], None
        for batch in batches:
            key, asks = batch.column("shard").to_numpy(), batch.column("asks").to_numpy()
            change = np.flatnonzero(np.append(True, (np.diff(key) != 0) | (np.diff(asks) != 0)))
            for a, b in zip(change, np.append(change[1:], len(key)), strict=True):
                part = batch.slice(a, b - a)
                if key[a] != now:
                    now, held, shard = key[a], [], None
                if not asks[a]:
                    held.append(part)
                elif held:
                    shard = shard or Shard(pa.Table.from_batches(held), width, m, k, stop)
                    yield answer(shard, part)
                else:
                    yield answer(None, part)

    return run


def nearest(df: DataFrame, *, key: str = "vec_id", vector: str = "embedding", queries: Column | None = None, k: int = 5, m: int = DIMENSIONS, sure: float = SURE, sample: int = SAMPLE, levels: int = LEVELS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """query_id, rank, vec_id and score (cosine) of the k nearest found of each query.

    queries: which rows ask (of a column vec_id; by default those whose id is divisible by 50). sample: the upper
    levels are cut from so many rows at most; every row is indexed.
    """
    spark = df.sparkSession
    prepare(spark)
    queries = F.col("vec_id") % 50 == 0 if queries is None else queries
    kind = df.schema[vector].dataType
    kind = "array<float>" if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else "array<double>"
    id_kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("vec_id"), F.col(vector).cast(kind).alias("v")).mapInArrow(_whole, f"vec_id {id_kind}, v {kind}, width long")
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    most = rows.groupBy("width").count().orderBy(F.desc("count"), "width").first()
    if most is None:
        return spark.createDataFrame([], f"query_id {id_kind}, rank int, vec_id {id_kind}, score double")
    width, n = most["width"], most["count"]
    rows = rows.where(F.col("width") == width).drop("width")
    stop, g = chi_square_quantile(sure, m), projection(width, m)

    def projected(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(list(_unit(_lists(batch.column(0), width)) @ g), pa.list_(pa.float64()))], ["p"])

    drawn = rows.where(F.pmod(F.xxhash64("row"), F.lit(1 << 20)) < max(1, min(1 << 20, 2 * sample * (1 << 20) // n))).limit(sample).select("v")
    points = np.array([r["p"] for r in drawn.mapInArrow(projected, "p array<double>").collect()]).reshape(-1, m)
    cells = Cells(points, max(0, min(levels, int(math.log2(max(1, len(points) / 16))))))
    n_cells = 1 << cells.levels

    def placed(batches):
        for batch in batches:
            p = _unit(_lists(batch.column(batch.schema.get_field_index("v")), width)) @ g
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells.of(p), pa.int64())], [*batch.schema.names, "cell"])

    def boxes(batches):
        low, high, count = np.full((n_cells, m), np.inf), np.full((n_cells, m), -np.inf), np.zeros(n_cells, np.int64)
        for batch in batches:
            p = _unit(_lists(batch.column(0), width)) @ g
            at = cells.of(p)
            np.minimum.at(low, at, p)
            np.maximum.at(high, at, p)
            count += np.bincount(at, minlength=n_cells)
        cell, dim = (x.ravel() for x in np.indices((n_cells, m)))
        keep = count[cell] > 0
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (cell, dim, low.ravel(), high.ravel(), count[cell])], ["cell", "dim", "low", "high", "n"])

    low, high, count = np.full((n_cells, m), np.inf), np.full((n_cells, m), -np.inf), np.zeros(n_cells, np.int64)
    found = rows.select("v").mapInArrow(boxes, "cell long, dim long, low double, high double, n long")
    for r in found.groupBy("cell", "dim").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).collect():  # 64 cells x m
        low[r["cell"], r["dim"]], high[r["cell"], r["dim"]], count[r["cell"]] = r["low"], r["high"], r["n"]
    held = max(1024, min(2 * n // n_cells, shard_bytes // (8 * width)))
    salts = np.maximum(1, -(-count // held))
    base = np.append(0, np.cumsum(salts))

    placed_kind = f"vec_id {id_kind}, v {kind}, row long, cell long"
    vectors = rows.select("vec_id", "v", "row").mapInArrow(placed, placed_kind)
    of_cell = lambda x: F.element_at(F.lit([int(v) for v in x]), F.col("cell").cast("int") + 1).cast("long")
    vectors = vectors.withColumn("shard", of_cell(base) + F.pmod(F.xxhash64("row"), of_cell(salts)))
    columns = ["shard", "asks", "row", "vec_id", "v", "bound2"]
    filed = vectors.withColumn("asks", F.lit(0)).withColumn("bound2", F.lit(None).cast("double")).select(*columns)
    asked = vectors.where(queries).withColumn("asks", F.lit(1)).withColumn("bound2", F.lit(math.inf)).select(*columns)
    stream = lambda asked: filed.unionByName(asked).repartition("shard").sortWithinPartitions("shard", "asks")

    def bounded(shard, part):
        row, raw = part.column("row").to_numpy(), _lists(part.column("v"), width)
        bound2 = np.full(len(row), np.inf) if shard is None else shard.search(row, raw, np.full(len(row), np.inf))[3]
        return pa.RecordBatch.from_arrays([part.column("row"), part.column("vec_id"), part.column("v"), pa.array(bound2)], ["row", "vec_id", "v", "bound2"])

    asked = cut(stream(asked).mapInArrow(_stream(width, m, k, stop, bounded), f"row long, vec_id {id_kind}, v {kind}, bound2 double"))

    def visits(batches):
        for batch in batches:
            p = _unit(_lists(batch.column("v"), width)) @ g
            bound2 = batch.column("bound2").to_numpy()
            with np.errstate(invalid="ignore"):
                near = (box_distance2(p[:, None], low[None], high[None]) <= stop * bound2[:, None] + 1e-9) & (count > 0)[None]
            q, cell = np.nonzero(near)
            q, at = np.repeat(q, salts[cell]), np.repeat(base[cell], salts[cell])
            first = np.flatnonzero(np.append(True, (np.diff(q) != 0) | (np.diff(at) != 0))) if len(q) else np.zeros(0, np.int64)
            at = at + np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
            take = pa.array(q)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(np.ones(len(at), np.int32)), *(batch.column(c).take(take) for c in columns[2:])], columns)

    def answered(shard, part):
        if shard is None:
            part = part.slice(0, 0)
            return pa.RecordBatch.from_arrays([part.column("row"), part.column("vec_id"), part.column("vec_id"), pa.array([], pa.float64())], ["row", "query_id", "vec_id", "score"])
        q, place, score, _ = shard.search(part.column("row").to_numpy(), _lists(part.column("v"), width), part.column("bound2").to_numpy())
        return pa.RecordBatch.from_arrays([part.column("row").take(pa.array(q)), part.column("vec_id").take(pa.array(q)), shard.ids.take(pa.array(place)), pa.array(score)], ["row", "query_id", "vec_id", "score"])

    visiting = asked.mapInArrow(visits, f"shard long, asks int, row long, vec_id {id_kind}, v {kind}, bound2 double")
    out = stream(visiting).mapInArrow(_stream(width, m, k, stop, answered), f"row long, query_id {id_kind}, vec_id {id_kind}, score double")
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc(F.round("score", 12)), F.col("vec_id").asc_nulls_first()))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
