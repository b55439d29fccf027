"""Benchmark decontamination: a prefix-filtered set join of benchmark windows with documents.

Each benchmark item is cut into windows of `window` words (an item of fewer words is one window). A
window is a set of positioned shingles, all of which a document must hold in order, so one necessary
prefix shingle per window suffices: its rarest. (1) The windows' shingles are counted over all documents;
(2) each window is filed under its rarest shingle, and left out if a shingle of it occurs nowhere;
(3) documents' shingles are joined with these by Spark; (4) the place of the shingle bounds where the
window would start and end, which must lie in the document, and (5) the words around it are compared with
the window's, as text. Of documents only shingles go into a shuffle that pass a bitmap of the shingles that
matter, which has 2**MOST_BITS bits at most, whatever the size of the benchmark: a larger one lets more
shingles pass, and the result is the same.

Cases. Null and empty texts have no words and no hits; items without words match nothing; items that
repeat count by their ids, once each; items of a null id are named by the empty string. Rows of
documents are judged one by one, whatever their ids; columns beyond the named ones are carried only
if asked for. An empty benchmark contaminates nothing. What the benchmark's windows say is joined back to
texts by a broadcast if few documents are hit, else by a shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexquarry.llm.spark import cut, prepare, small
from lexquarry.llm.textnum import ALNUM_LOWER, U64, Words, int64, lists, slices, word_counts

SHINGLE = 5
#: Bits of the bitmap: 16 a shingle, between these powers of two (32 MB at most).
LEAST_BITS, MOST_BITS = 20, 28
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _strings(words: Words, data: np.ndarray, first: int, last: int) -> list[str]:
    """The words [first, last) of a slice of texts, lower-cased."""
    low, at = data[words.start[first] : words.end[last - 1]].tobytes().translate(_LOWER), words.start[first]
    return [low[a - at : b - at].decode() for a, b in zip(words.start[first:last], words.end[first:last], strict=True)]


def _windows(window: int):
    """Every window of every item: its words as text, its shingles."""

    def body(batches):
        for batch in batches:
            names, sizes, texts, shingles, row = [], [], [], [], 0
            for _, _, data, offsets in slices(batch.column(1)):
                words = Words(data, offsets, ALNUM_LOWER)
                grams = {}
                for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True):
                    k = min(window, b - a)
                    if k:
                        size = min(SHINGLE, k)
                        if size not in grams:
                            grams[size] = words.grams(size)
                        own, shown = grams[size], _strings(words, data, a, b)
                        for at in range(b - a - k + 1):
                            names.append(batch.column(0)[row].as_py())
                            sizes.append(k)
                            texts.append(" ".join(shown[at : at + k]))
                            shingles.append(int64(own[a + at : a + at + k - size + 1]))
                    row += 1
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int32()), pa.array(texts, pa.string()), lists(shingles, pa.int64())], ["name", "k", "words", "shingles"])

    return body


def bitmap(hashes: DataFrame) -> tuple[np.ndarray, int]:
    """Two bits set for each value of the column `hash`, and how many bits there are (their power of two)."""
    n = hashes.count()
    power = min(MOST_BITS, max(LEAST_BITS, (16 * n).bit_length()))
    places = F.array(*(c.bitwiseAND((1 << power) - 1) + 1 for c in (F.col("hash"), F.shiftrightunsigned("hash", 36))))
    place = hashes.select(F.explode(places).alias("p"))
    maps = place.groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")).collect()
    out = np.zeros(max(1 << power - 3, 4096), np.uint8)
    for row in maps:
        out[(row["bucket"] - 1) * 4096 : row["bucket"] * 4096] = np.frombuffer(bytes(row["bits"]), np.uint8)
    return out, power


def passing(grams: np.ndarray, bits: np.ndarray, power: int) -> np.ndarray:
    """Which hashes have both bits set."""
    mask = U64((1 << power) - 1)
    one = lambda p: (bits[(p >> U64(3)).astype(np.int64)] >> (p & U64(7)).astype(np.uint8)) & 1
    return (one(grams & mask) & one((grams >> U64(36)) & mask)).astype(bool)


def _met(words: Words, sizes: list[int], bits: np.ndarray, power: int):
    """(shingle size, places, hashes) of the shingles that pass, in a slice of texts."""
    for size in sizes:
        grams = words.grams(size)
        at = np.flatnonzero(passing(grams, bits, power))
        ends = np.searchsorted(words.bounds, at, "right")
        at = at[at + size <= words.bounds[ends]]
        yield size, at, grams[at]


def _counted(sizes: list[int], bits: Broadcast, power: int):
    def body(batches):
        for batch in batches:
            found = [h for _, _, data, offsets in slices(batch.column(0)) for _, _, h in _met(Words(data, offsets, ALNUM_LOWER), sizes, bits.value, power)]
            hashes, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(int64(hashes)), pa.array(n, pa.int64())], ["hash", "n"])

    return body


def _placed(sizes: list[int], window: int, bits: Broadcast, power: int):
    """The shingles that pass, their places and the words around them."""

    def body(batches):
        for batch in batches:
            rows, counts, hashes, places, around, before, row = [], [], [], [], [], [], 0
            for _, _, data, offsets in slices(batch.column(2)):
                words = Words(data, offsets, ALNUM_LOWER)
                for size, at, h in _met(words, sizes, bits.value, power):
                    text = np.searchsorted(words.bounds, at, "right") - 1
                    # a shingle shorter than SHINGLE is a whole window
                    more = window - size if size == SHINGLE else 0
                    for place, t, own in zip(at.tolist(), text.tolist(), int64(h).tolist(), strict=True):
                        first, last = max(int(words.bounds[t]), place - more), min(int(words.bounds[t + 1]), place + size + more)
                        rows.append(row + t)
                        counts.append(int(words.bounds[t + 1] - words.bounds[t]))
                        hashes.append(own)
                        places.append(place - int(words.bounds[t]))
                        around.append(_strings(words, data, first, last))
                        before.append(place - first)
                row += len(offsets) - 1
            rows = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(counts, pa.int64()), pa.array(hashes, pa.int64()), pa.array(places, pa.int32()), pa.array(around, pa.list_(pa.string())), pa.array(before, pa.int32())],
                ["id", "tk", "n_words", "hash", "place", "around", "before"],
            )

    return body


def hits(docs: DataFrame, items: DataFrame, window: int) -> DataFrame | None:
    """n_words, n_hit and the sorted names of items of each (id, tk) of docs that any window hits; None without any window. docs: id, tk, text; items: name, text."""
    sc = docs.sparkSession.sparkContext
    windows = items.mapInArrow(_windows(window), "name string, k int, words string, shingles array<long>")
    windows = cut(windows.groupBy("k", "words").agg(F.sort_array(F.collect_set("name")).alias("names"), F.first("shingles").alias("shingles")))
    sizes = sorted(min(SHINGLE, r["k"]) for r in windows.select(F.least("k", F.lit(SHINGLE)).alias("k")).distinct().collect())
    if not sizes:
        return None
    each = windows.select("k", "words", F.posexplode("shingles").alias("at", "hash"))
    bits, power = bitmap(each.select("hash").distinct())
    counts = docs.select("text").mapInArrow(_counted(sizes, sc.broadcast(bits), power), "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
    rarest = each.join(counts, "hash", "left").groupBy("k", "words").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "at", "hash")).alias("r")).where("r.n > 0")
    filed = cut(rarest.join(windows.select("k", "words", "names"), ["k", "words"]).select("k", "words", "names", "r.at", "r.hash"))
    bits, power = bitmap(filed.select("hash").distinct())
    placed = docs.mapInArrow(_placed(sizes, window, sc.broadcast(bits), power), f"id {docs.schema['id'].dataType.simpleString()}, tk long, n_words long, hash long, place int, around array<string>, before int")
    # kept before the join, so that its sides are plain exchanges and a hot shingle's partition can be split
    met = cut(placed).join(filed, "hash")
    start = F.col("place") - F.col("at")
    inside = (start >= 0) & (start + F.col("k") <= F.col("n_words")) & (F.col("before") >= F.col("at"))
    met = met.where(inside).where(F.array_join(F.slice("around", F.col("before") - F.col("at") + 1, F.col("k")), " ") == F.col("words"))
    found = met.groupBy("id", "tk").agg(F.min("n_words").alias("n_words"), F.collect_set(F.struct(start.alias("a"), F.col("k"))).alias("spans"), F.collect_set("names").alias("names"))
    # spans in order, each counted from where those before it ended
    order = F.aggregate(F.array_sort("spans"), F.struct(F.lit(0).alias("until"), F.lit(0).cast("long").alias("n")), lambda s, x: F.struct(F.greatest(s["until"], x["a"] + x["k"]).alias("until"), (s["n"] + F.greatest(F.lit(0), x["a"] + x["k"] - F.greatest(s["until"], x["a"]))).alias("n")))
    return found.select("id", "tk", "n_words", order["n"].alias("n_hit"), F.array_sort(F.array_distinct(F.flatten("names"))).alias("names"))


def decontaminate(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 13, one_in: int = 20, carry: tuple[str, ...] = (), sizes: bool = True) -> DataFrame:
    """The columns `carry` of each document, _n_words (if sizes), _n_hit, _n_items, _items_sha256 and _contaminated (hit words are at least one in `one_in`)."""
    prepare(docs.sparkSession)
    named = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("name"), F.col(item_text).alias("text")).where("text <> ''")
    # rows are known by id and a hash of the text; those alike in both have the same hits
    known = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("tk"), F.col(text_col).alias("text"))
    found = hits(known, named, window)
    kept = [F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)]
    out = docs.select(F.col(text_col).alias("_text"), F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_tk"), *kept)
    if sizes:  # only documents that are hit are counted otherwise
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields[1:])
        out = out.mapInArrow(word_counts(ALNUM_LOWER), f"n long, {fields}").withColumnRenamed("n", "_n")
    none = F.sha2(F.lit(""), 256)
    if found is None:
        out = out.select("*", *(F.lit(0).cast("long").alias(c) for c in ("n_hit", "n_items")), none.alias("sum"))
    else:
        found = small(found.select("id", "tk", "n_hit", F.size("names").cast("long").alias("n_items"), F.sha2(F.encode(F.array_join("names", ","), "UTF-8"), 256).alias("sum"), "n_words"))
        out = out.join(found, F.col("_id").eqNullSafe(F.col("id")) & (F.col("_tk") == F.col("tk")), "left")
    zero = F.lit(0).cast("long")
    hit = F.coalesce("n_hit", zero)
    bad = (hit > 0) & (hit * one_in >= (zero if found is None else F.coalesce("n_words", zero)))
    words = [F.col("_n").alias("_n_words")] if sizes else []
    return out.select(*(F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)), *words, hit.alias("_n_hit"), F.coalesce("n_items", zero).alias("_n_items"), F.coalesce("sum", none).alias("_items_sha256"), bad.alias("_contaminated"))
