"""Word segmentation without a given dictionary: words are learned from the corpus, texts are cut along their best path.

A dictionary holds every Han character and the character sequences that hold together (of all ways to cut them in two,
none is likely by chance) and stand in varied company (entropy of the neighbours on either side). All of it is counted
by Spark. A word's cost is minus the logarithm of its share, in millionths, so that sums are exact; a text's words are
those of the least total cost, of equal ones the longer word first.

Up to BROADCAST_WORDS words go to the tasks as a prefix trie in flat arrays, followed from all places of a batch at
once. More are joined to the places where they occur, and each run's path is found from the words met there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words that every task may hold: some 40 bytes each.
BROADCAST_WORDS = 1_000_000
HAN = "一-鿿"
#: Tokens that aren't Han: numbers and Latin words with what belongs to them, else single marks.
OTHER = "[A-Za-z0-9]+(?:[.%％-][A-Za-z0-9]+)*[%％]?"
_STEP = 1_000_000


def runs(texts: DataFrame, text: str = "text") -> DataFrame:
    """Runs of Han characters, a row each (run)."""
    return texts.select(F.explode(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(f"([{HAN}]+)"), F.lit(1))).alias("run"))


def dictionary(texts: DataFrame, *, text: str = "text", most: int = 4, at_least: int = 5, cohesion: float = 8.0, entropy: float = 0.5) -> DataFrame:
    """word, n and cost: all characters, and sequences of 2 to `most` of them that occur `at_least` times.

    cohesion: least n * total / (n of the one part * n of the other) over all cuts in two. entropy: of the characters
    before and of those after a sequence (the start and the end of a run count as one more), the least it may have.
    """
    spans = F.explode(F.sequence(F.lit(1), F.length("run"))).alias("at")
    # runs that repeat are cut once
    each = runs(texts, text).groupBy("run").agg(F.count("*").alias("times")).select("run", "times", spans).select("run", "times", "at", F.explode(F.sequence(F.lit(1), F.least(F.lit(most), F.length("run") - F.col("at") + 1))).alias("size"))
    part = lambda start, size: F.col("run").substr(start, size)
    each = each.select(
        part(F.col("at"), F.col("size")).alias("word"), "size", "times",
        F.when(F.col("at") > 1, part(F.col("at") - 1, F.lit(1))).otherwise("").alias("before"), part(F.col("at") + F.col("size"), F.lit(1)).alias("after"),
    )
    # one shuffle of counts by company; the rest is made of these
    company = each.groupBy("word", "size", "before", "after").agg(F.sum("times").alias("n"))

    def varied(side: str) -> DataFrame:
        by = company.where("size > 1").groupBy("word", side).agg(F.sum("n").alias("n"))
        return by.groupBy("word").agg((F.log(F.sum("n")) - F.sum(F.col("n") * F.log("n")) / F.sum("n")).alias(f"h_{side}"))

    counts = company.groupBy("word", "size").agg(F.sum("n").alias("n"))
    total = counts.where("size = 1").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("total"))
    often = counts.where((F.col("size") > 1) & (F.col("n") >= at_least))
    cuts = often.select("word", "n", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("cut"))
    cuts = cuts.select("word", "n", F.col("word").substr(F.lit(1), F.col("cut")).alias("a"), F.col("word").substr(F.col("cut") + 1, F.length("word")).alias("b"))
    of = lambda name: counts.select(F.col("word").alias(name), F.col("n").alias(f"n_{name}"))
    bound = cuts.join(of("a"), "a").join(of("b"), "b").join(F.broadcast(total), F.lit(True))
    bound = bound.groupBy("word").agg(F.first("n").alias("n"), F.min(F.col("n") * F.col("total") / (F.col("n_a") * F.col("n_b"))).alias("cohesion"))
    words = bound.where(F.round("cohesion", 6) >= cohesion).join(varied("before"), "word").join(varied("after"), "word")
    words = words.where(F.round(F.least("h_before", "h_after"), 6) >= entropy).select("word", "n")
    every = words.unionByName(counts.where("size = 1").select("word", "n"))
    shares = every.agg(F.sum("n").cast("double").alias("all"))
    return every.join(F.broadcast(shares), F.lit(True)).select("word", "n", F.round(_STEP * F.log(F.col("all") / F.col("n"))).cast("long").alias("cost"))


class Trie:
    """Words in flat arrays: the child of a node for a character is found in one sorted array of both."""

    def __init__(self, words: list[str], costs: list[int]):
        order = sorted(range(len(words)), key=words.__getitem__)
        child: dict[tuple[int, int], int] = {}
        cost = [-1]
        for i in order:
            node = 0
            for c in map(ord, words[i]):
                node = child.setdefault((node, c), len(cost))
                if node == len(cost):
                    cost.append(-1)
            cost[node] = costs[i]
        keys = np.array([(n << 21) | c for n, c in child], np.int64)
        by = np.argsort(keys)
        self.keys, self.nodes, self.cost = keys[by], np.array(list(child.values()), np.int64)[by], np.array(cost, np.int64)
        self.most = max(map(len, words), default=1)
        #: a character that no word has costs more than any word
        self.unknown = max(costs, default=0) + _STEP

    def costs(self, points: np.ndarray) -> np.ndarray:
        """Of each place and size (a row each) the cost of the word that starts there, or -1."""
        n = len(points)
        out = np.full((self.most, n), -1, np.int64)
        node = np.zeros(n, np.int64)
        for size in range(self.most):
            alive = np.flatnonzero((node >= 0) & (np.arange(n) + size < n))
            key = (node[alive] << 21) | points[alive + size]
            at = np.minimum(np.searchsorted(self.keys, key), max(0, len(self.keys) - 1))
            hit = self.keys[at] == key if len(self.keys) else np.zeros(len(key), bool)
            node = np.full(n, -1, np.int64)
            node[alive[hit]] = self.nodes[at[hit]]
            out[size, alive[hit]] = self.cost[node[alive[hit]]]
        out[0] = np.where(out[0] < 0, self.unknown, out[0])
        return out


def best_path(costs: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Size of the word to take at each place of runs that stand one after another (lengths), all runs at a time from their ends."""
    total = int(length.sum())
    ends = np.cumsum(length)
    # each run has one place more, behind its last
    slot = np.arange(total) + np.repeat(np.arange(len(length)), length)
    best, size = np.zeros(total + len(length), np.int64), np.zeros(total, np.int64)
    order = np.argsort(-length, kind="stable")
    sorted_length = length[order]
    for back in range(1, int(length.max(initial=0)) + 1):
        at = ends[order[: int(np.searchsorted(-sorted_length, -back, side="right"))]] - back
        least, take = np.full(len(at), np.iinfo(np.int64).max), np.ones(len(at), np.int64)
        for n in range(1, min(back, len(costs)) + 1):
            own = costs[n - 1, at]
            sum_ = own + best[slot[at] + n]
            better = (own >= 0) & (sum_ <= least)  # of equal ones the longer
            least, take = np.where(better, sum_, least), np.where(better, n, take)
        best[slot[at]], size[at] = least, take
    return size


def _pieces(text: str) -> Iterator[tuple[bool, str]]:
    """(whether Han, piece) of what a text holds besides white space."""
    import re

    for m in re.finditer(f"([{HAN}]+)|({OTHER})|\\S", text):
        yield m[1] is not None, m[0]


class Segmenter:
    """Cuts texts into words of a dictionary (word, cost)."""

    def __init__(self, words: DataFrame):
        self.words = words
        self.n = words.count()
        self._trie = None

    def save(self, folder: str) -> None:
        self.words.write.mode("overwrite").parquet(folder)

    @staticmethod
    def load(spark: SparkSession, folder: str) -> Segmenter:
        return Segmenter(spark.read.parquet(folder))

    def trie(self):
        """The dictionary as a broadcast trie."""
        if self.n > BROADCAST_WORDS:
            raise ValueError(f"{self.n} words are more than a task may hold; segment() joins them instead")
        if self._trie is None:
            rows = self.words.select("word", "cost").collect()  # BROADCAST_WORDS at most
            self._trie = self.words.sparkSession.sparkContext.broadcast(Trie([r["word"] for r in rows], [r["cost"] for r in rows]))
        return self._trie

    def tokens(self, text: Column) -> Column:
        """The tokens of a text in order: words, numbers, Latin words, single marks. For operators.bm25.build()."""
        trie = self.trie()

        @F.pandas_udf("array<string>")
        def cut(texts: pd.Series) -> pd.Series:
            pieces = [list(_pieces(t)) if t else [] for t in texts]
            han = [p for row in pieces for is_han, p in row if is_han]
            points = np.frombuffer("".join(han).encode("utf-32-le"), np.uint32).astype(np.int64)
            length = np.array([len(p) for p in han], np.int64)
            costs = trie.value.costs(points)
            # a word ends with its run
            left = np.repeat(np.cumsum(length), length) - np.arange(len(points))
            costs[np.arange(len(costs))[:, None] >= left[None]] = -1
            size, at, out = best_path(costs, length).tolist(), 0, []
            for row in pieces:
                words = []
                for is_han, p in row:
                    if not is_han:
                        words.append(p)
                        continue
                    i = 0
                    while i < len(p):
                        words.append(p[i : i + size[at + i]])
                        i += size[at + i]
                    at += len(p)
                out.append(words)
            return pd.Series(out)

        return cut(text)

    def segment(self, texts: DataFrame, *, key: str, text: str = "text") -> DataFrame:
        """key and tokens (of null texts: none). Beyond BROADCAST_WORDS the words are joined to the places where they occur."""
        if self.n <= BROADCAST_WORDS:
            return texts.select(key, self.tokens(F.col(text)).alias("tokens"))
        most, unknown = self.words.agg(F.max(F.length("word")), F.max("cost")).first()
        pieces = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(f"([{HAN}]+|{OTHER}|[^\\s])"), F.lit(1))
        rows = texts.withColumn("_row", F.monotonically_increasing_id()).select("_row", key, F.posexplode_outer(pieces).alias("no", "piece"))
        # the path of each distinct run, known by its text
        han = texts.select(F.explode(pieces).alias("piece")).where(F.col("piece").rlike(f"^[{HAN}]")).distinct()
        places = han.select("piece", F.explode(F.sequence(F.lit(1), F.length("piece"))).alias("at"))
        places = places.select("piece", "at", F.explode(F.sequence(F.lit(1), F.least(F.lit(most), F.length("piece") - F.col("at") + 1))).alias("size"))
        met = places.withColumn("word", F.col("piece").substr(F.col("at"), F.col("size"))).join(self.words.select("word", "cost"), "word")
        met = met.groupBy("piece").agg(F.collect_list(F.struct("at", "size", "cost")).alias("met"))
        paths = han.join(met, "piece", "left").select("piece", _along("piece", "met", unknown + _STEP).alias("path"))
        cut = F.coalesce("path", F.when(F.col("piece").isNotNull(), F.array("piece")), F.array().cast("array<string>"))
        done = rows.join(paths, "piece", "left").groupBy("_row", key).agg(F.array_sort(F.collect_list(F.struct("no", cut.alias("tokens")))).alias("all"))
        return done.select(key, F.flatten(F.transform("all", lambda x: x["tokens"])).alias("tokens"))


def _along(piece: str, met: str, unknown: int) -> Column:
    @F.pandas_udf("array<string>")
    def cut(pieces: pd.Series, found: pd.Series) -> pd.Series:
        out = []
        for p, words in zip(pieces, found, strict=True):
            words = [] if words is None else words
            costs = np.full((max([1, *(w["size"] for w in words)]), len(p)), -1, np.int64)
            costs[0] = unknown
            for w in words:
                costs[w["size"] - 1, w["at"] - 1] = w["cost"]
            size, i, cuts = best_path(costs, np.array([len(p)])), 0, []
            while i < len(p):
                cuts.append(p[i : i + size[i]])
                i += size[i]
            out.append(cuts)
        return pd.Series(out)

    return cut(piece, met)


def learn(texts: DataFrame, **options) -> Segmenter:
    """A segmenter by the words of the texts themselves."""
    return Segmenter(dictionary(texts, **options))


