"""Near-duplicate documents: one-permutation MinHash, banded buckets, star-shaped candidate edges.

Steps: (1) each text becomes its set of k-word shingles (64-bit hashes); equal sets form one class, and
classes, not ids, are what is linked; (2) one permutation splits the hash space into bins, the least hash
of each bin is the signature, empty bins borrow from a bin found along a fixed random order (optimal
densification); (3) bands of the signature key buckets; each bucket links its members to its smallest
class, a star, so n members make n - 1 candidate pairs; (4) candidates are confirmed on the full
sets; (5) connected components. A star could miss a link between two members of which one isn't like
the centre. Members of buckets that still hold several components are therefore joined exactly, by
prefixes: shingles are put in one order, rare ones first, and two sets that are alike enough share one of
the first n - least intersection + 1 shingles. So members of a bucket that share boilerplate only are not
compared with each other, however many they are.

Cases. Null or empty text and texts without words have an empty set and are linked with nothing. A text
of fewer than k words is one shingle. A null id stays unlinked, with a null component. Rows that repeat
an id are judged each by its own text; the least id reachable is taken over rows. Other columns of the
input are ignored; an empty table gives none. A class is known by the size of its set and 128 bits of
sums over it, and by 64 bits of these where classes are linked.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexquarry.llm.graph import components
from lexquarry.llm.spark import cut, prepare, small
from lexquarry.llm.textnum import SPACED_LOWER, U64, Words, int64, lists, mix, slices


def shingle_sets(column: pa.Array, k: int):
    """Per text, the sorted distinct shingle hashes."""
    for _, _, data, offsets in slices(column):
        words = Words(data, offsets, SPACED_LOWER)
        grams = words.grams(k)
        for a, b in zip(words.bounds[:-1], words.bounds[1:], strict=True):
            if b - a >= k:
                yield np.unique(grams[a : b - k + 1])
            elif b > a:
                h = words.hash[a:b]
                yield mix(np.array([np.bitwise_xor.reduce(h * U64(3) ** np.arange(1, b - a + 1, dtype=np.uint64)) + U64(b - a)], np.uint64))
            else:
                yield np.zeros(0, np.uint64)


class Signer:
    """Signatures of bands * rows bins, as one key per band."""

    def __init__(self, bands: int, rows: int, seed: int = 11):
        self.bands, self.rows = bands, rows
        bins = bands * rows
        self.edges = np.array([(i << 64) // bins + (i > 0) for i in range(bins)], np.uint64)
        rng = np.random.default_rng(seed)
        self.order = np.argsort(rng.random((bins, bins)), axis=1).astype(np.int16)
        self.factor = rng.integers(1, 1 << 63, rows, dtype=np.uint64) | U64(1)
        self.salt = rng.integers(1, 1 << 63, bands, dtype=np.uint64)

    def keys(self, shingles: np.ndarray) -> np.ndarray:
        at = np.searchsorted(shingles, self.edges)
        full = at < np.append(at[1:], len(shingles))
        least = shingles[np.minimum(at, len(shingles) - 1)]
        if len(empty := np.flatnonzero(~full)):
            order = self.order[empty]
            least[empty] = least[order[np.arange(len(empty)), np.argmax(full[order], axis=1)]]
        return mix((mix(least).reshape(self.bands, self.rows) * self.factor).sum(axis=1, dtype=np.uint64) + self.salt)


#: (rows, bands) by the least similarity: a pair exactly that similar shares no band once in a million.
def banding(similarity: float) -> tuple[int, int]:
    rows = 7 if similarity >= 0.85 else 6 if similarity >= 0.8 else 4
    return rows, int(np.ceil(np.log(1e-6) / np.log(1 - similarity**rows)))


def _sums(s: np.ndarray) -> tuple[np.uint64, np.uint64]:
    """What tells a set from others, with its size."""
    return s.sum(dtype=np.uint64), mix(s ^ U64(0x2545F4914F6CDD1D)).sum(dtype=np.uint64)


def _signed(k: int, bands: int, rows: int):
    def run(batches):
        signer = Signer(bands, rows)
        for batch in batches:
            n, sums, keys = [], [], []
            for s in shingle_sets(batch.column(1), k):
                n.append(len(s))
                sums.append(_sums(s))
                keys.append(int64(signer.keys(s)) if len(s) else np.zeros(0, np.int64))
            sums = np.array(sums, np.uint64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(int64(sums[:, 0].copy())), pa.array(int64(sums[:, 1].copy())), lists(keys, pa.int64())], ["id", "n", "h1", "h2", "bands"])

    return run


def _sets(k: int):
    """The set of each text, once a task where texts repeat."""

    def run(batches):
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            sums, parts = [], []
            for s in shingle_sets(batch.column(0), k):
                own = tuple(x.item() for x in _sums(s))
                if own not in seen:
                    seen.add(own)
                    sums.append(own)
                    parts.append(int64(s))
            sums = np.array(sums, np.uint64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array([len(s) for s in parts], pa.int64()), pa.array(int64(sums[:, 0].copy())), pa.array(int64(sums[:, 1].copy())), lists(parts, pa.int64())], ["n", "h1", "h2", "shingles"])

    return run


#: Shingles that a member's row names as those before its own, so that a pair which met there isn't taken again.
SEEN = 32


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, at_least: tuple[int, int] = (80, 100)) -> DataFrame:
    """One row per document: doc_id, n_shingles, class_id (the least id with the same set), component_id, kept.

    Documents are linked if intersection / union of their sets is at least at_least[0] / at_least[1].
    """
    prepare(docs.sparkSession)
    above, below = at_least
    rows, bands = banding(above / below)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = cut(texts.mapInArrow(_signed(k, bands, rows), "id long, n long, h1 long, h2 long, bands array<long>"))
    own = ["n", "h1", "h2"]
    linkable = F.col("id").isNotNull() & (F.col("n") > 0)
    # copies are counted before they are shuffled; equal sets have equal bands
    classes = cut(signed.where(linkable).groupBy(*own).agg(F.min("id").alias("least"), F.count("*").alias("many"), F.first("bands").alias("bands")).withColumn("node", F.xxhash64(*own)))
    reps = classes.select("node", "n", F.explode("bands").alias("key"))
    # kept before the join, so that its sides are plain exchanges and a hot bucket's partition can be split
    stars = cut(reps.groupBy("key").agg(F.min("node").alias("centre"), F.max("node").alias("other")).where("centre < other").drop("other"))
    buckets = cut(reps.join(stars, "key").select("key", "node", "n", "centre"))
    wanted = classes.join(buckets.select("node").distinct(), "node", "left_semi")
    sets = texts.join(wanted.select(F.col("least").alias("id")).distinct(), "id", "left_semi").select("text").mapInArrow(_sets(k), "n long, h1 long, h2 long, shingles array<long>")
    sets = cut(sets.select(F.xxhash64(*own).alias("node"), "shingles"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        side = lambda name: sets.select(F.col("node").alias(name), F.col("shingles").alias(f"s{name}"))
        both = pairs.join(side("b"), "b").join(side("a"), "a")
        common = F.size(F.array_intersect("sa", "sb"))
        return both.where(common * below >= above * (F.size("sa") + F.size("sb") - common)).select("a", "b").distinct()

    fits = lambda x, y: (F.col(x) * below >= F.col(y) * above) & (F.col(y) * below >= F.col(x) * above)
    sizes = buckets.select(F.col("node").alias("centre"), F.col("n").alias("n_centre")).distinct()
    first = buckets.where("node > centre").select("centre", "node", "n").distinct().join(sizes, "centre").where(fits("n", "n_centre"))
    edges = cut(confirmed(first.select(F.col("centre").alias("a"), F.col("node").alias("b"))))
    labels = components(edges)

    # members of buckets that still hold several components
    split = lambda rows, by: rows.groupBy(by).agg(F.min("c").alias("c1"), F.max("c").alias("c2")).where("c1 < c2").select(by)
    placed = buckets.join(labels, "node", "left").select("key", "node", "n", F.coalesce("component", "node").alias("c"))
    left = cut(placed.join(split(placed, "key"), "key", "left_semi").select("node", "c", "n").distinct())
    if not left.isEmpty():
        each = sets.join(left, "node").select("node", "c", "n", F.explode("shingles").alias("token"))
        # counted before the join, so that its sides are plain exchanges and a hot shingle's partition can be split
        common = cut(each.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"))
        known = each.join(common, "token").groupBy("node", "c", "n").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("tokens"))
        # shingles that no other member has come first; then the rarest
        alone = F.col("n") - F.size("tokens")
        take = F.col("n") - F.expr(f"(n * {above} + {below - 1}) div {below}") + 1 - alone
        firsts = F.transform(F.slice("tokens", F.lit(1), F.greatest(take, F.lit(0)).cast("int")), lambda t: t["token"])
        heads = known.where(take > 0).select("node", "c", "n", alone.alias("alone"), firsts.alias("firsts")).select("*", F.posexplode("firsts").alias("i", "token"))
        heads = cut(heads.select("node", "c", "n", (F.col("alone") + F.col("i")).alias("at"), "token", F.slice("firsts", F.lit(1), F.least("i", F.lit(SEEN))).alias("seen")))
        met = cut(heads.join(cut(split(heads, "token")), "token"))
        # every pair across components has a member outside the token's largest one
        most = cut(met.groupBy("token", "c").agg(F.count("*").alias("many")).groupBy("token").agg(F.max(F.struct("many", "c")).alias("most")).select("token", F.col("most.c").alias("largest")))
        met = cut(met.join(most, "token").withColumn("last", F.col("c") == F.col("largest")).drop("largest"))
        others = met.where("not last").select("token", *(F.col(c).alias(f"{c}_a") for c in ("node", "c", "n", "at", "seen")))
        # with the first shingle that two sets share, what follows it bounds what they share
        bound = F.least(F.col("n") - F.col("at"), F.col("n_a") - F.col("at_a"))
        # and there the pair is compared, not again at others
        near = fits("n", "n_a") & ~F.arrays_overlap("seen", "seen_a") & (bound * below >= above * (F.col("n") + F.col("n_a") - bound))
        pairs = others.join(met, "token").where((F.col("c") != F.col("c_a")) & (F.col("last") | (F.col("node") > F.col("node_a"))) & near)
        more = cut(confirmed(pairs.select(F.col("node_a").alias("a"), F.col("node").alias("b")).distinct()))
        if not more.isEmpty():
            labels = components(edges.unionByName(more))

    both = F.explode(F.array(F.struct("node", "component"), F.struct(F.col("component").alias("node"), "component")))
    linked = cut(classes.select("node", "least").join(labels.select(both.alias("e")).select("e.*").distinct(), "node"))
    least = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    linked = small(linked.join(least, "component").select("node", "component_id"))
    copies = small(classes.where("many > 1").select(*own, "least"))
    out = signed.where(linkable).select("id", *own, F.xxhash64(*own).alias("node")).join(copies, own, "left").join(linked, "node", "left")
    out = out.select("id", "n", F.coalesce("least", "id").alias("class_id"), F.coalesce("component_id", "least", "id").alias("component_id"))
    rest = signed.where(~linkable).select("id", "n", F.col("id").alias("class_id"), F.col("id").alias("component_id"))
    return out.unionByName(rest).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "class_id", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
