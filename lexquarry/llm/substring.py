"""Substring dedup: Rabin-Karp hashes of every window of so many words, counted in Spark.

A word goes if a window over it also starts in a document of a smaller id. Windows of a document are
hashed all; a window that can't repeat is counted without being shuffled, because of its anchors: of
each run of WINNOW consecutive short grams the least hash is an anchor, every window holds a whole run,
so equal windows hold an equal anchor, and a window without an anchor that two documents share is
unique. The others are counted exactly (least id by hash), joined back, and merged into maximal
intervals. Equal documents (by number of words and two hashes of them all) are one for this: the least
id stands for all, later ones go whole.

Cases. Null and empty texts have no words; texts shorter than a window lose none. Rows of a null id are
kept whole and take nothing from others. Rows repeating an id aren't held against each other. Other
columns are ignored; an empty table gives none. A window is known by its Rabin-Karp hash (61 bits) and
32 bits of a hash of another kind, so that no pattern of words makes two windows meet; the words
themselves are not compared, since that would move the texts of both documents.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexquarry.llm.spark import cut, prepare, small
from lexquarry.llm.textnum import SPACED, Words, check_hash, int64, lists, rabin_karp, sequence_hashes, slices


def least_of_runs(x: np.ndarray, run: int) -> np.ndarray:
    """Places of the least value of each `run` consecutive values (all values, if they are fewer)."""
    n = len(x)
    if n <= run:
        return np.array([int(np.argmin(x))]) if n else np.zeros(0, np.int64)
    pad = -n % run
    y = np.append(x, np.full(pad, np.iinfo(np.uint64).max, np.uint64)).reshape(-1, run)
    down = np.minimum.accumulate(y, axis=1).ravel()
    up = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(up[: n - run + 1], down[run - 1 : n])
    # a value is the least of some run over it iff it equals the greatest of the least values of those runs
    return np.flatnonzero(x == greatest_around(least, run))


def greatest_around(least: np.ndarray, run: int) -> np.ndarray:
    """For each value, the greatest of the least values of the runs over it."""
    padded = np.concatenate([np.zeros(run - 1, np.uint64), least, np.zeros(run - 1, np.uint64)])
    n = len(least) + run - 1
    pad = -len(padded) % run
    y = np.append(padded, np.zeros(pad, np.uint64)).reshape(-1, run)
    down = np.maximum.accumulate(y, axis=1).ravel()
    up = np.maximum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.maximum(up[:n], down[run - 1 : run - 1 + n])


def _anchored(window: int, gram: int):
    run = window - gram + 1

    def body(batches):
        for batch in batches:
            n, h1, h2, hashes, places = [], [], [], [], []
            for _, _, data, offsets in slices(batch.column(2)):
                words = Words(data, offsets, SPACED)
                grams = words.grams(gram)
                a, b = sequence_hashes(words)
                h1.append(a)
                h2.append(b)
                for lo, hi in zip(words.bounds[:-1], words.bounds[1:], strict=True):
                    n.append(hi - lo)
                    own = grams[lo : hi - gram + 1] if hi - lo >= window else grams[:0]
                    at = least_of_runs(own, run)
                    hashes.append(int64(own[at]))
                    places.append(at.astype(np.int32))
            cat = lambda x: pa.array(int64(np.concatenate(x)) if x else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), cat(h1), cat(h2), lists(hashes, pa.int64()), lists(places, pa.int32())], ["id", "tk", "n", "h1", "h2", "anchors", "places"])

    return body


def _windows(window: int, gram: int):
    """Hashes and places of the windows over the given anchors."""

    def body(batches):
        for batch in batches:
            hashes, checks, places, row = [], [], [], 0
            anchors = batch.column(3)
            for _, _, data, offsets in slices(batch.column(2)):
                words = Words(data, offsets, SPACED)
                grams, other = rabin_karp(words.hash, window), check_hash(words.hash, window).view(np.int32)
                for lo, hi in zip(words.bounds[:-1], words.bounds[1:], strict=True):
                    at = np.asarray(anchors[row].values)
                    row += 1
                    size = hi - lo - window + 1
                    cover = np.zeros(size + 1, np.int32)
                    np.add.at(cover, np.clip(at + gram - window, 0, size), 1)
                    np.add.at(cover, np.clip(at + 1, 0, size), -1)
                    own = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
                    hashes.append(int64(grams[lo + own]))
                    checks.append(other[lo + own])
                    places.append(own.astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists(hashes, pa.int64()), lists(checks, pa.int32()), lists(places, pa.int32())], ["id", "tk", "hashes", "checks", "places"])

    return body


def intervals(starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs [from, until) of words that windows starting at `starts` cover."""
    starts = np.unique(starts)
    fresh = np.append(True, starts[1:] > starts[:-1] + window)
    return starts[fresh], np.append(starts[:-1][fresh[1:]], starts[-1]) + window


def _merged(window: int):
    def body(batches):
        for batch in batches:
            both = [intervals(np.asarray(x.values), window) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists([b[0] for b in both], pa.int32()), lists([b[1] for b in both], pa.int32())], ["id", "tk", "since", "until"])

    return body


def _kept(texts: bool):
    def body(batches):
        for batch in batches:
            n, gone, kept, sums = [], [], [], []
            for text, since, until in zip(batch.column(0).cast(pa.binary()), batch.column(1), batch.column(2), strict=True):
                words = (text.as_py() or b"").split()
                n.append(len(words))
                if until.is_valid:
                    for a, b in zip(reversed(since.as_py()), reversed(until.as_py()), strict=True):
                        del words[a:b]
                gone.append(n[-1] - len(words))
                joined = b" ".join(words)
                sums.append(hashlib.sha256(joined).hexdigest())
                kept.append(joined.decode() if texts else None)
            rest = [batch.column(i) for i in range(3, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sums, pa.string()), pa.array(kept, pa.string())], [*batch.schema.names[3:], "_n_words", "_n_removed", "_kept_sha256", "_kept"])

    return body


def repeated_substrings(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 50, gram: int = 10, carry: tuple[str, ...] = (), texts: bool = False) -> DataFrame:
    """The columns `carry` of each document, and _n_words, _n_removed, _kept_sha256, _kept (the words left; null unless texts).

    gram: words of an anchor; shorter ones make fewer anchors but more of them meet by chance.
    """
    prepare(docs.sparkSession)
    key = F.hash(F.col(text_col))
    keyed = docs.select(F.col(id_col).cast("long").alias("id"), key.alias("tk"), F.col(text_col).alias("text"))
    seen = cut(keyed.where("id is not null").mapInArrow(_anchored(window, gram), "id long, tk int, n long, h1 long, h2 long, anchors array<long>, places array<int>"))
    long = seen.where(F.col("n") >= window)
    same = long.groupBy("n", "h1", "h2").agg(F.min("id").alias("first"))
    placed = long.join(same, ["n", "h1", "h2"])
    copies = placed.where("id > first").select("id", "tk").distinct()
    grams = placed.where("id = first").select("id", "tk", F.explode(F.arrays_zip("anchors", "places")).alias("e")).select("id", "tk", F.col("e.anchors").alias("anchor"), F.col("e.places").alias("place"))
    # kept before the join, so that its sides are plain exchanges and a hot anchor's partition can be split
    shared = cut(grams.groupBy("anchor").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("anchor"))
    met = small(grams.join(shared, "anchor").groupBy("id", "tk").agg(F.collect_set("place").alias("met")), "met")
    counted = cut(keyed.join(met, ["id", "tk"]).select("id", "tk", "text", "met").mapInArrow(_windows(window, gram), "id long, tk int, hashes array<long>, checks array<int>, places array<int>"))
    each = counted.select("id", "tk", F.explode(F.arrays_zip("hashes", "checks", "places")).alias("e")).select("id", "tk", F.col("e.hashes").alias("hash"), F.col("e.checks").alias("check"), F.col("e.places").alias("place"))
    firsts = cut(each.groupBy("hash", "check").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("hash", "check", "first"))
    later = each.join(firsts, ["hash", "check"]).where("id > first").groupBy("id", "tk").agg(F.collect_set("place").alias("starts"))
    parts = later.mapInArrow(_merged(window), "id long, tk int, since array<int>, until array<int>")
    whole = copies.select("id", "tk", F.array(F.lit(0)).alias("since"), F.array(F.lit((1 << 31) - 1)).alias("until"))
    marks = small(parts.unionByName(whole), "since", "until")
    out = docs.select(F.col(id_col).cast("long").alias("_id"), key.alias("_tk"), F.col(text_col).alias("_text"), *carry).join(marks, (F.col("_id") == F.col("id")) & (F.col("_tk") == F.col("tk")), "left")
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry), "_n_words long", "_n_removed long", "_kept_sha256 string", "_kept string"])
    return out.select("_text", "since", "until", *carry).mapInArrow(_kept(texts), schema)
