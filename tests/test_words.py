"""Word segmentation against plain versions, and BM25 by learned words."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from lexquarry.operators import bm25, words
from lexquarry.operators.words import Segmenter, Trie, dictionary
from pyspark.sql import functions as F

HAN = "税务机关纳人应当缴"


def plain_path(piece, costs, most):
    unknown = max(costs.values()) + 1_000_000
    best = {len(piece): (0, [])}
    for i in range(len(piece) - 1, -1, -1):
        found = []
        for n in range(1, min(most, len(piece) - i) + 1):
            cost = costs.get(piece[i : i + n], unknown if n == 1 else None)
            if cost is not None:
                found.append((cost + best[i + n][0], -n, [piece[i : i + n], *best[i + n][1]]))
        cost, _, path = min(found)
        best[i] = (cost, path)
    return best[0][1]


def plain_tokens(text, costs, most):
    out = []
    for p in re.findall(r"[一-鿿]+|[A-Za-z0-9]+(?:[.%％-][A-Za-z0-9]+)*[%％]?|\S", text or ""):
        out += plain_path(p, costs, most) if "一" <= p[0] <= "鿿" else [p]
    return out


def texts(n=300):
    rng = random.Random(7)
    some = ["税务机关", "纳税人", "应当", "缴纳", "，", " ", "2.5%", "VAT-1", "龘", "é", "\n", "第1条", "关", "人", "。"]
    rows = ["".join(rng.choice(some) for _ in range(rng.randint(0, 12))) for _ in range(n)]
    return [*rows, None, "", " ", "税" * 700, "a.b.c% %", "税务机关" * 200]


def test_dictionary_is_counted_as_defined(spark):
    rows = texts()
    df = spark.createDataFrame([(t,) for t in rows], "text string").repartition(3)
    got = {r.word: (r.n, r.cost) for r in dictionary(df, most=3, at_least=4, cohesion=3.0, entropy=0.4).collect()}
    n, before, after = Counter(), defaultdict(Counter), defaultdict(Counter)
    for t in rows:
        for run in re.findall("[一-鿿]+", t or ""):
            for i in range(len(run)):
                for k in range(1, min(3, len(run) - i) + 1):
                    w = run[i : i + k]
                    n[w] += 1
                    before[w][run[i - 1] if i else ""] += 1
                    after[w][run[i + k : i + k + 1]] += 1
    total = sum(c for w, c in n.items() if len(w) == 1)
    entropy = lambda c: math.log(sum(c.values())) - sum(x * math.log(x) for x in c.values()) / sum(c.values())
    keep = {w: c for w, c in n.items() if len(w) == 1 or (c >= 4 and min(c * total / (n[w[:i]] * n[w[i:]]) for i in range(1, len(w))) >= 3.0 and min(entropy(before[w]), entropy(after[w])) >= 0.4)}
    every = sum(keep.values())
    assert {w: c for w, (c, _) in got.items()} == keep and "纳税人" in keep
    assert all(abs(cost - 1_000_000 * math.log(every / keep[w])) <= 1 for w, (_, cost) in got.items())


@pytest.mark.parametrize("limit", [words.BROADCAST_WORDS, 0])
def test_segments_are_best_paths(spark, monkeypatch, limit):
    """Through the trie, and through the join beyond what is broadcast; ties take the longer word first."""
    monkeypatch.setattr(words, "BROADCAST_WORDS", limit)
    rng = random.Random(1)
    costs = {"".join(rng.choice(HAN) for _ in range(rng.randint(1, 4))): rng.randint(1, 6) * 100_000 for _ in range(150)}
    rows = texts() + ["".join(rng.choice(HAN) for _ in range(rng.randint(1, 30))) for _ in range(200)]
    segmenter = Segmenter(spark.createDataFrame(list(costs.items()), "word string, cost long"))
    df = spark.createDataFrame(list(enumerate(rows)), "id int, text string").repartition(4)
    got = {r.id: r.tokens for r in segmenter.segment(df, key="id").collect()}
    most = max(map(len, costs))
    assert got == {i: plain_tokens(t, costs, most) for i, t in enumerate(rows)}
    if not limit:
        with pytest.raises(ValueError, match="joins them"):
            segmenter.trie()


def test_trie_without_words():
    import numpy as np

    trie = Trie([], [])
    assert trie.costs(np.array([30000, 30001])).tolist() == [[1_000_000, 1_000_000]]


def test_bm25_by_words(spark, tmp_path):
    """A saved dictionary and index answer by words: a text that holds the word comes first, pairs across words count no more."""
    rows = [(i, f"d{i}", "", t, 1, None) for i, t in enumerate(["纳税人应当缴纳税款", "税务机关应当退还税款", "纳税人不得申报", "人应"] * 10)]
    chunks = spark.createDataFrame(rows, "chunk_ix long, doc_id string, doc_title string, text string, is_latest int, row_range string")
    words.learn(chunks, cohesion=2.0, entropy=0.0, at_least=5).save(str(tmp_path / "words"))
    segmenter = Segmenter.load(spark, str(tmp_path / "words"))
    bm25.build(chunks, tokenizer=segmenter.tokens).save(str(tmp_path / "index"))
    asked = spark.createDataFrame([("q", "税务机关")], "qid string, question string")
    index = bm25.Index.load(spark, str(tmp_path / "index"), tokenizer=segmenter.tokens)
    hits = index.retrieve(asked, k=10, drilldown=False).collect()
    assert [r.text for r in hits] == ["税务机关应当退还税款"] * 10
    unsaved = bm25.build(chunks, tokenizer=segmenter.tokens).retrieve(asked, k=10, drilldown=False)
    assert sorted((r.chunk_ix, r.score) for r in unsaved.collect()) == sorted((r.chunk_ix, r.score) for r in hits)
    assert spark.read.parquet(str(tmp_path / "index/postings")).where(F.col("term") == "税务机关").count() == 10
