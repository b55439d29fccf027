"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of a whole text (shares of kinds of characters, word lengths, repetition, lines) are cut into at
most 64 quantile bins; trees of depth four are grown on the binned gradients of the logistic loss. The model
is flattened into arrays (feature, threshold, leaf values, by level) and scored for whole batches by index
arithmetic, without a branch.

Training takes at most `sample` labelled rows, the first by a hash of the id, of the rows not held out; that
bound is a parameter, all else covers every row.

Cases. Null and empty texts are scored by their (zero) statistics. Labels that are null are not used; an id
labelled several times counts so often. Without labels, or labels of one kind only, every score is that
kind's share (0.5 for none). Other columns are ignored unless carried.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexquarry.llm.spark import prepare
from lexquarry.llm.textnum import SPACED_LOWER, Words, slices

_KINDS = np.zeros(256, np.int64)  # 0 other symbols
for _b in range(256):
    _c = chr(_b)
    _KINDS[_b] = 7 if _b >= 128 else 1 if "a" <= _c <= "z" else 2 if "A" <= _c <= "Z" else 3 if _c.isdigit() else 4 if _c == "\n" else 5 if _c.isspace() else 6 if _c in ".,;:!?'\"-()" else 8 if _c == "|" else 0
N_KINDS = 9
NAMES = ("log_bytes", "log_words", *(f"kind_{i}" for i in range(N_KINDS)), "word_length", "word_length_sd", "longest_word", "short_words", "distinct_words", "top_word", "same_as_last", "distinct_pairs", "distinct_trigrams", "ends_in_symbol", "ends_in_stop", "shouted", "exclamations", "bytes_a_line", "same_lines")


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of NAMES for each text of a slice."""
    n = len(offsets) - 1
    out = np.zeros((n, len(NAMES)), np.float32)
    words = Words(data, offsets, SPACED_LOWER)
    kinds = _KINDS[data]
    length = (words.end - words.start).astype(np.float64)
    last = kinds[words.end - 1] if len(words.end) else np.zeros(0, np.int64)
    first_two = (kinds[words.start] == 2) & (kinds[np.minimum(words.start + 1, len(kinds) - 1)] == 2) if len(words.start) else np.zeros(0, bool)
    bang = data == 33
    for i, ((a, b), (p, q)) in enumerate(zip(pairwise(offsets), pairwise(words.bounds), strict=True)):
        size, count = b - a, q - p
        if not size:
            continue
        row = out[i]
        row[0] = np.log1p(size)
        row[1] = np.log1p(count)
        row[2 : 2 + N_KINDS] = np.bincount(kinds[a:b], minlength=N_KINDS) / size
        j = 2 + N_KINDS
        if count:
            h, own = words.hash[p:q], length[p:q]
            sets = np.sort(h)
            cut = np.flatnonzero(np.append(True, sets[1:] != sets[:-1]))
            runs = np.diff(np.append(cut, count))
            pairs = h[:-1] * np.uint64(31) + h[1:]
            triples = pairs[:-1] * np.uint64(31) + h[2:]
            row[j : j + 13] = (
                own.mean(), own.std(), own.max(), (own <= 3).mean(), len(cut) / count, runs.max() / count,
                (h[1:] == h[:-1]).mean() if count > 1 else 0,
                len(np.unique(pairs)) / len(pairs) if len(pairs) else 1,
                len(np.unique(triples)) / len(triples) if len(triples) else 1,
                np.isin(last[p:q], (0, 8)).mean(), (last[p:q] == 6).mean(), first_two[p:q].mean(), bang[a:b].sum() / count,
            )
        ends = np.append(np.flatnonzero(kinds[a:b] == 4), size)
        row[j + 13] = np.log1p(size / len(ends))
        row[j + 14] = 1 - len({data[x:y].tobytes() for x, y in zip(np.append(a, a + ends[:-1] + 1), a + ends, strict=True)}) / len(ends)
    return out


class Trees:
    """Boosted trees of one depth, flattened: split features and thresholds of all nodes by level, leaf values."""

    def __init__(self, depth: int, base: float):
        self.depth, self.base = depth, base
        self.feature, self.threshold, self.leaf = [], [], []

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 150, depth: int = 4, rate: float = 0.1, bins: int = 64, shrink: float = 2.0, least: float = 2.0) -> Trees:
        share = float(np.clip(y.mean(), 1e-6, 1 - 1e-6)) if len(y) else 0.5
        model = Trees(depth, float(np.log(share / (1 - share))))
        if len(y) < 2 or y.min() == y.max():
            return model.flat(x.shape[1])
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], axis=1)
        n, d = binned.shape
        raw = np.full(n, model.base)
        flat_bin = binned + np.arange(d) * bins
        for _ in range(trees):
            p = 1 / (1 + np.exp(-raw))
            g, h = y - p, p * (1 - p)
            node = np.zeros(n, np.int64)
            feature, threshold = [], []
            for level in range(depth):
                k = 1 << level
                at = (node[:, None] * (d * bins) + flat_bin).ravel()
                sums = [np.bincount(at, np.repeat(v, d), k * d * bins).reshape(k, d, bins).cumsum(axis=2) for v in (g, h)]
                gl, hl = sums
                gt, ht = gl[:, :1, -1:], hl[:, :1, -1:]
                gain = gl**2 / (hl + shrink) + (gt - gl) ** 2 / (ht - hl + shrink) - gt**2 / (ht + shrink)
                gain[(hl < least) | (ht - hl < least)] = 0
                best = gain.reshape(k, -1).argmax(axis=1)
                f, b = best // bins, best % bins
                none = gain.reshape(k, -1).max(axis=1) <= 1e-9
                b[none] = bins
                feature.append(f)
                threshold.append(np.array([np.inf if b[i] >= len(cuts[f[i]]) else cuts[f[i]][b[i]] for i in range(k)]))
                node = 2 * node + (binned[np.arange(n), f[node]] > b[node])
            leaves = 1 << depth
            value = rate * np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + shrink)
            raw += value[node]
            model.feature.append(np.concatenate(feature))
            model.threshold.append(np.concatenate(threshold))
            model.leaf.append(value)
        return model.flat(d)

    def flat(self, d: int) -> Trees:
        nodes, leaves = (1 << self.depth) - 1, 1 << self.depth
        self.feature = np.array(self.feature, np.int64).reshape(-1, nodes)
        self.threshold = np.array(self.threshold, np.float64).reshape(-1, nodes)
        self.leaf = np.array(self.leaf, np.float64).reshape(-1, leaves)
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = (1 << level) - 1 + node
                node = 2 * node + (x[rows, f[at]] > t[at])
            raw += leaf[node]
        return 1 / (1 + np.exp(-raw))


def _measured(batches):
    for batch in batches:
        rows = [r.tobytes() for _, _, data, offsets in slices(batch.column(0)) for r in statistics(data, offsets)]
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), batch.column(1), batch.column(2)], ["x", "y", "h"])


def is_held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 12_000) -> Trees:
    prepare(docs.sparkSession)
    usable = labels.where(~is_held_out(id_col) & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), (F.col(label_col) > 0).cast("int").alias("y"))
    chosen = F.broadcast(usable.orderBy(F.xxhash64("id", F.lit(3)), "id", "y").limit(sample))  # at most `sample` pairs of numbers
    # an id may be repeated any number of times: the bound holds for rows
    found = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(chosen, "id")
    found = found.select("text", "y", F.xxhash64("id", "text", F.lit(3)).alias("h")).mapInArrow(_measured, "x binary, y int, h long")
    rows = found.orderBy("h", "x", "y").limit(sample).collect()
    rows = sorted((bytes(r["x"]), r["y"]) for r in rows)
    x = np.array([np.frombuffer(r[0], np.float32) for r in rows]).reshape(-1, len(NAMES))
    return Trees.fit(x, np.array([r[1] for r in rows], np.float64))


def _scored(model: Trees):
    def body(batches):
        for batch in batches:
            scores = [model.score(statistics(data, offsets)) for _, _, data, offsets in slices(batch.column(0))]
            rest = range(1, batch.num_columns)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in rest), pa.array(np.concatenate(scores) if scores else np.zeros(0))], [*batch.schema.names[1:], "_score"])

    return body


def score_quality(docs: DataFrame, model: Trees, *, text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """The columns `carry` of each document, and _score."""
    prepare(docs.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in carry), "_score double"])
    return docs.select(F.col(text_col).alias("_text"), *carry).mapInArrow(_scored(model), schema)
