"""Language ID by error-correcting output codes over hashed byte trigrams.

Every language has a codeword; a logistic classifier per bit is trained on whether a text's codeword has
it. A text is decoded to the codeword of the least loss, each bit's loss weighted by how well that bit's
classifier did in training; the score is the chosen language's share of exp(-loss), and a text whose two
nearest codewords lie closer than `margin` is flagged as ambiguous.

Training takes at most `per_language` texts of each language, and fewer of each if there are so many languages
that these would make more than `rows` texts, the first by a hash of id and text; those bounds are
parameters, and all else (features, prediction) covers whole texts of all rows.

Cases. Null texts and texts without a letter are `und` with score 0. Without any usable label every text
is `und`; with one language all others than `und` are that one. Null ids are held in; repeated rows are
judged alike. Other columns are ignored unless carried.
"""

from __future__ import annotations

from itertools import combinations, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexquarry.llm.spark import cut, prepare, small
from lexquarry.llm.textnum import slices

BUCKETS = 2048
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_FOLD[[b for b in range(128) if not chr(b).isalpha()]] = 32


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Square roots of the shares of hashed trigrams of each text (unit length)."""
    n = len(offsets) - 1
    out = np.zeros((n, BUCKETS), np.float32)
    if len(data) < 3:
        return out
    c = _FOLD[data]
    code = ((c[:-2] * np.uint32(0x9E3779B1)) ^ (c[1:-1] * np.uint32(0x85EBCA77)) ^ (c[2:] * np.uint32(0xC2B2AE3D))) * np.uint32(0x27D4EB2F)
    code = (code >> np.uint32(21)).astype(np.int64)
    for i, (a, b) in enumerate(pairwise(offsets)):
        if b - a >= 3:
            out[i] = np.sqrt(np.bincount(code[a : b - 2], minlength=BUCKETS) / (b - a - 2))
    return out


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def codewords(n: int) -> np.ndarray:
    """n rows of +-1. Up to five: every split of the languages; beyond: the random code of 10 log2 n bits that keeps rows furthest apart."""
    if n <= 5:
        bits = [[1 if i == 0 or i in ones else -1 for i in range(n)] for k in range(n - 1) for ones in combinations(range(1, n), k)]
        return np.array(bits, np.float64).T.reshape(n, -1)
    size, rng = int(np.ceil(10 * np.log2(n))), np.random.default_rng(7)
    nearest = lambda m: max(np.max(m[a : a + 500] @ m.T - 2 * size * np.eye(len(m[a : a + 500]), n, a)) for a in range(0, n, 500))
    return min((rng.choice([-1.0, 1.0], (n, size)) for _ in range(50 if n <= 500 else 3)), key=nearest)


class Model:
    def __init__(self, languages: list[str], code: np.ndarray, weights: np.ndarray, bias: np.ndarray, trust: np.ndarray):
        self.languages, self.code, self.weights, self.bias, self.trust = languages, code, weights, bias, trust

    @staticmethod
    def fit(x: np.ndarray, labels: list[str], steps: int = 150) -> Model:
        languages = sorted(set(labels))
        code = codewords(len(languages))
        _, place, size = np.unique(np.array(labels, object), return_inverse=True, return_counts=True)
        y = code[place]
        share = (1 / size)[place][:, None] / len(languages)
        w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1])
        v, vb = np.zeros_like(w), np.zeros_like(b)
        for _ in range(steps):  # accelerated gradient on the logistic loss with a little shrinkage
            slope = -share * y / (1 + np.exp(np.clip(y * (x @ (w + 0.9 * v) + b + 0.9 * vb), -30, 30)))
            v = 0.9 * v - 4.0 * (x.T @ slope.astype(np.float32) + 1e-5 * w)
            vb = 0.9 * vb - 4.0 * slope.sum(axis=0)
            w, b = w + v, b + vb
        right = ((x @ w + b) * y > 0).mean(axis=0) if len(x) else np.zeros(0)
        return Model(languages, code, w.astype(np.float32), b, np.clip(right, 0.05, 1))

    def losses(self, x: np.ndarray) -> np.ndarray:
        margin = x @ self.weights + self.bias
        return np.stack([(np.logaddexp(0, -margin * c) * self.trust).sum(axis=1) for c in self.code], axis=1)

    def decode(self, x: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language number, score and ambiguity."""
        loss = self.losses(x)
        best = loss.argmin(axis=1)
        share = np.exp(loss.min(axis=1, keepdims=True) - loss)
        second = np.partition(loss, 1, axis=1)[:, 1] if loss.shape[1] > 1 else np.full(len(loss), np.inf)
        return best, 1 / share.sum(axis=1), second - loss.min(axis=1) < margin


def _featured(batches):
    """Features of each text once a task; rows of one key have equal texts."""
    seen = set()
    for batch in batches:
        keys = list(zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True))
        fresh = [i for i, k in enumerate(keys) if k not in seen and not seen.add(k)]
        batch = batch.take(pa.array(fresh, pa.int64()))
        rows = [r for _, _, data, offsets in slices(batch.column(0)) for r in features(data, offsets).astype(np.float16)]
        yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in rows], pa.binary()), *(batch.column(i) for i in range(1, 5))], ["x", "label", "h", "t", "n"])


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 500, rows: int = 100_000) -> Model | None:
    """Fits on rows that are not held out. Every language is learned; with more than rows / per_language of them each has fewer texts, one at least."""
    prepare(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("label")).where(~is_held_out("id") & F.col("label").isNotNull() & F.col("text").isNotNull())
    # rows are known by hashes of id and text, so that ids may be null or repeated; rows of a null id are ordered by their texts
    # rows are known by hashes of id and text, so that ids may be null or repeated
    texts = texts.withColumn("t", F.xxhash64("text")).select("text", "label", F.xxhash64("id", "t", F.lit(3)).alias("h"), "t")
    held_in = texts.select("label", "h", "t")
    counts = small(held_in.groupBy("label").agg(F.count("*").alias("all")))
    per_language = max(1, min(per_language, rows // max(1, counts.count())))
    # Of each language the least hashes: those under a level that some more than the wanted rows should lie under are
    # counted by value before they are shuffled, and the level is raised where a language comes up short.
    wanted, wide, some = F.least(F.lit(per_language), "all"), 2.0, None
    while some is None or not counts.join(some.groupBy("label").agg(F.sum("n").alias("n")), "label", "left").where(F.coalesce("n", F.lit(0)) < wanted).isEmpty():
        under = F.col("h") / F.lit(2.0**64) + 0.5 <= F.lit(wide * per_language + 8 * wide) / F.col("all")
        some = cut(held_in.join(counts, "label").where(under).groupBy("label", "h", "t").agg(F.count("*").alias("n")))
        wide *= 8
    before = F.sum("n").over(Window.partitionBy("label").orderBy("h", "t").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    chosen = some.withColumn("before", before).where(F.col("before") < per_language).select("label", "h", "t", F.least("n", per_language - F.col("before")).alias("n"))
    keys = F.broadcast(chosen)  # no more rows of three numbers and a name than texts are learned from
    found = texts.join(keys, ["label", "h", "t"]).select("text", "label", "h", "t", "n").mapInArrow(_featured, "x binary, label string, h long, t long, n long")
    found = found.dropDuplicates(["label", "h", "t"]).collect()
    if not found:
        return None
    found = sorted(((r["label"], bytes(r["x"])) for r in found for _ in range(r["n"])))
    x = np.stack([np.frombuffer(own, np.float16) for _, own in found]).astype(np.float32)
    return Model.fit(x, [label for label, _ in found])


def is_held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def _predicted(model: Model | None, margin: float):
    def body(batches):
        for batch in batches:
            texts = batch.column(0)
            names, scores, flags = [], [], []
            for i, j, data, offsets in slices(texts):
                lettered = [has_letter(t) for t in texts.slice(i, j - i).to_pylist()]
                if model is None:
                    best, score, flag = [0] * (j - i), [0.0] * (j - i), [True] * (j - i)
                    lettered = [False] * (j - i)
                else:
                    best, score, flag = model.decode(features(data, offsets), margin)
                names += [model.languages[b] if ok else "und" for b, ok in zip(best, lettered, strict=True)]
                scores += [float(s) if ok else 0.0 for s, ok in zip(score, lettered, strict=True)]
                flags += [bool(f) if ok else True for f, ok in zip(flag, lettered, strict=True)]
            rest = range(1, batch.num_columns)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in rest), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(flags, pa.bool_())], [*batch.schema.names[1:], "_lang", "_score", "_ambiguous"])

    return body


def identify(docs: DataFrame, model: Model | None, *, text_col: str = "text", margin: float = 1.0, carry: tuple[str, ...] = ()) -> DataFrame:
    """The columns `carry` of each document, and _lang, _score, _ambiguous."""
    prepare(docs.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in carry), "_lang string", "_score double", "_ambiguous boolean"])
    return docs.select(F.col(text_col).alias("_text"), *carry).mapInArrow(_predicted(model, margin), schema)
