r"""URL filters: a trie over reversed host labels, then path segments, broadcast to the executors.

A rule is a host and a path, `example.com/en/7`: it fits the host and its subdomains wherever the url's path
starts with the rule's. Walking the labels from the right passes every host a rule may name; at each, the
path's segments are walked down, and the last segment of a rule, which need not be whole, is tried as a
prefix. The longest rule that fits decides; of two as long, the one with the longer host; an entry both
allowed and blocked is blocked. Urls that no rule fits get the default verdict.

Up to MAX_RULES rules are one trie (measured: 0.9 KB a rule in each Python worker, 0.12 KB sent). More rules, which can come as a DataFrame,
stay in Spark: rules are keyed by the host and whole segments that lead to their last node, each distinct url
by those of the nodes it passes, and the two are joined. The result is the same.

Cases. A null url and one without `://` have an empty host and path, which no rule fits. Ports, user names and
trailing dots count as part of the host. Rows are judged one by one; other columns are kept if carried.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexquarry.llm.spark import cut, prepare

MAX_RULES = 100_000
_URL = re.compile(r"\A.*?://([^/?#]*)([^?#]*)", re.S)
_LOWER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})


def split_url(url: str | None) -> tuple[str, str]:
    """Host, A-Z lower-cased, and path; both empty without `://`."""
    m = _URL.match(url) if url else None
    return (m[1].translate(_LOWER), m[2]) if m else ("", "")


def split_rule(rule: str) -> tuple[str, str, str]:
    """Host, the path's whole segments with the slash after them, and the last segment, which may be a part."""
    host, slash, path = rule.partition("/")
    whole, slash, last = (slash + path).rpartition("/")
    return host.translate(_LOWER), whole + slash, last


class Trie:
    """Nodes are numbers: down[node, label] leads from the root (0) along labels, and along path segments from below[node of a host].

    ends[node] holds the last segments, whole or not, of the rules that end there.
    """

    def __init__(self, rules: Iterable[tuple[str, str]]):
        self.down: dict[tuple[int, str], int] = {}
        self.below: dict[int, int] = {}
        self.ends: dict[int, dict[str, tuple[str, str]]] = {}
        self.longest = 0
        size = 1
        for action, rule in rules:
            host, whole, last = split_rule(rule)
            node = 0
            for label in reversed(host.split(".")):
                if (to := self.down.setdefault((node, label), size)) == size:
                    size += 1
                node = to
            if (to := self.below.setdefault(node, size)) == size:
                size += 1
            node = to
            for segment in whole.split("/")[:-1]:
                if (to := self.down.setdefault((node, segment), size)) == size:
                    size += 1
                node = to
            ends = self.ends.setdefault(node, {})
            self.longest = max(self.longest, len(last))
            if last not in ends or action == "block":
                ends[last] = (action, rule)

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """(action, rule) of the longest rule that fits."""
        best, node = None, 0
        if not host:
            return None
        for label in reversed(host.split(".")):
            node = self.down.get((node, label))
            if node is None:
                break
            if (at := self.below.get(node)) is not None:
                for segment in path.split("/"):
                    if ends := self.ends.get(at):
                        # longest first; a prefix of the segment, so as many steps as the segment is long
                        for n in range(min(len(segment), self.longest), -1, -1):
                            if segment[:n] in ends:
                                found = ends[segment[:n]]
                                if best is None or len(found[1]) >= len(best[1]):
                                    best = found
                                break
                    at = self.down.get((at, segment))
                    if at is None:
                        break
        return best


def _judged(trie, default: str):
    def body(batches):
        for batch in batches:
            parts = [split_url(u) for u in batch.column(0).to_pylist()]
            found = [trie.value.find(*p) for p in parts]
            rest = range(1, batch.num_columns)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in rest), pa.array([p[0] for p in parts], pa.string()), pa.array([p[1] for p in parts], pa.string()), pa.array([f and f[1] for f in found], pa.string()), pa.array([f[0] if f else default for f in found], pa.string())],
                [*batch.schema.names[1:], "_host", "_path", "_rule", "_verdict"],
            )

    return body


def _passed(batches):
    """Of each url the host and whole segments of every node it passes, and what follows there."""
    for batch in batches:
        urls, keys, rests = [], [], []
        for url in batch.column(0).to_pylist():
            host, path = split_url(url)
            labels = host.split(".") if host else []
            ends = [0, *(i + 1 for i, c in enumerate(path) if c == "/")]
            for i in range(len(labels)):
                suffix = ".".join(labels[i:])
                for end in ends:
                    urls.append(url)
                    keys.append(suffix + path[:end])
                    rests.append(path[end:])
        yield pa.RecordBatch.from_arrays([pa.array(urls, pa.string()), pa.array(keys, pa.string()), pa.array(rests, pa.string())], ["url", "key", "rest"])


def _split(batches):
    for batch in batches:
        parts = [split_rule(r) for r in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([h + w for h, w, _ in parts], pa.string()), pa.array([p for _, _, p in parts], pa.string()), pa.array([len(h) for h, _, _ in parts], pa.int32())], ["action", "rule", "key", "last", "host"])


def _joined(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """url, action and rule of distinct urls that a rule fits."""
    keyed = cut(rules.select("action", "rule").mapInArrow(_split, "action string, rule string, key string, last string, host int").distinct())
    met = urls.where("url is not null").distinct().mapInArrow(_passed, "url string, key string, rest string").join(keyed, "key").where(F.startswith("rest", F.col("last")))
    best = F.max(F.struct(F.length("rule").alias("size"), "host", (F.col("action") == "block").alias("block"), "action", "rule"))
    return cut(met.groupBy("url").agg(best.alias("best")).select("url", "best.action", "best.rule"))


def filter_urls(pages: DataFrame, rules: Iterable[tuple[str, str]] | DataFrame, *, url_col: str = "url", default: str = "allow", carry: tuple[str, ...] = ()) -> DataFrame:
    """The columns `carry` of each page, and _host, _path, _rule (null if none fits) and _verdict. rules: (allow or block, host/path), listed or a DataFrame of action and rule."""
    spark = pages.sparkSession
    prepare(spark)
    if not isinstance(rules, DataFrame):
        rules = list(rules)
        if len(rules) > MAX_RULES:
            rules = spark.createDataFrame(rules, "action string, rule string")
    elif rules.count() <= MAX_RULES:
        rules = [(r["action"], r["rule"]) for r in rules.select("action", "rule").collect()]
    trie = spark.sparkContext.broadcast(Trie([] if isinstance(rules, DataFrame) else rules))
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in carry), "_host string", "_path string", "_rule string", "_verdict string"])
    if not isinstance(rules, DataFrame):
        return pages.select(F.col(url_col).alias("_url"), *carry).mapInArrow(_judged(trie, default), schema)
    found = _joined(pages.select(F.col(url_col).alias("url")), rules).select(F.col("url").alias("_found"), F.col("action").alias("_action"), F.col("rule").alias("_fits"))
    # the trie without rules splits the urls
    out = pages.select(F.col(url_col).alias("_url"), F.col(url_col).alias("_key"), *(F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)))
    split = ", ".join(["_key string", *(f"_c{i} {kinds[c]}" for i, c in enumerate(carry)), "_host string", "_path string", "_rule string", "_verdict string"])
    out = out.mapInArrow(_judged(trie, default), split).join(found, F.col("_key") == F.col("_found"), "left")
    return out.select(*(F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)), "_host", "_path", F.col("_fits").alias("_rule"), F.coalesce("_action", "_verdict").alias("_verdict"))
