"""Operators 11 to 13 against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from lexquarry.llm import alignment, convtrie, neighbours
from lexquarry.llm import spark as own
from lexquarry.llm.alignment import align_tokens, cut_places, pair
from lexquarry.llm.convtrie import Louds, conversation_trie, running
from lexquarry.llm.neighbours import Tree, chi_square_quantile, nearest

import cases

# Conversations

CONVERSATIONS = "conv_id long, turn long, role string, text string, depth long, p1 string, size int, seg int"


def awkward_conversations():
    rng = random.Random(4)
    rows = []
    for c in range(-12, 60):
        first = rng.choice([["hello é"], ["hello é", "two"], ["x"]])
        for t, x in enumerate(first + [rng.choice(["a", "b", "", None]) for _ in range(rng.randint(0, 9))]):
            rows.append((c, t, rng.choice(["user", "user", None, "system"]), x))
    rows += [(0, 1, "user", "tie"), (0, 1, "user", "tie"), (0, 1, "tool", "tie"), (5, None, "user", "null turn"), (5, None, "user", "other"), (None, 0, "user", "no id"), (1007, 0, "user", "only one")]
    rows += [(1 << 62, 0, None, None), (1 << 62, 3, "user", "far")]
    rows += [(100 + 5 * i, t, "user", f"same {t}") for i in range(40) for t in range(3)]
    rng.shuffle(rows)
    return rows


def trie(rows, borrow=(5, 9)):
    convs = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            convs[c].append((t is not None, t or 0, hashlib.sha256(f"{len(r)}:{r}{x}".encode()).hexdigest(), (r, x)))
    own_turns = {c: [y[3] for y in sorted(v, key=lambda y: y[:3])] for c, v in convs.items()}
    built = {}
    for c, v in own_turns.items():
        h = zlib.crc32(str(c).encode()) % borrow[1] if borrow else 0
        base = c - int(math.copysign(abs(c) % borrow[0], c)) if borrow else c
        built[c] = own_turns.get(base, [])[:h] + v[h:]
    members = defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
    children, leaves, saved = Counter(k[:-1] for k in members if k), Counter(), Counter()
    for k in sorted(members, key=len, reverse=True):
        saved[k] += (len(members[k]) - 1) * (len(k[-1][1].encode()) if k else 0)
        leaves[k] += not children[k]
        if k:
            leaves[k[:-1]] += leaves[k]
            saved[k[:-1]] += saved[k]
    digest = lambda k, m: hashlib.sha256(",".join(str(c) for c in m if len(built[c]) == len(k)).encode()).hexdigest()
    return sorted((m[0], len(k), members[k[:-1]][0] if k else -1, len(m), children[k], leaves[k], saved[k], digest(k, m)) for k, m in members.items())


def found_trie(df, **more):
    return sorted(tuple(-1 if x is None else x for x in r) for r in conversation_trie(df, **more).collect())


@pytest.mark.parametrize("shard_rows", [1, 6, 512])
def test_trie_of_awkward_conversations(spark, shard_rows):
    rows = awkward_conversations()
    df = spark.createDataFrame([(*r, 3, "p", 1, 2) for r in rows], CONVERSATIONS).repartition(3)
    assert found_trie(df, shard_rows=shard_rows) == trie(rows)
    assert found_trie(df, shard_rows=shard_rows, borrow=None) == trie(rows, None)


def test_trie_with_shuffled_joins(spark, monkeypatch):
    rows = awkward_conversations()
    df = spark.createDataFrame([(*r, 3, "p", 1, 2) for r in rows], CONVERSATIONS)
    monkeypatch.setattr(own, "BROADCAST_BYTES", -1)
    assert found_trie(df, shard_rows=4) == trie(rows)


def test_trie_of_one_conversation_and_of_none(spark):
    """A conversation that no shard holds and that lies in several partitions; an empty table."""
    rows = [(10, t, "user", f"t{t % 7}") for t in range(3000)] + [(12, t, "user", f"t{t % 7}") for t in range(1500)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    assert found_trie(df, shard_rows=64) == trie(rows)
    assert found_trie(df.where("false")) == []
    alone = [(3, 0, "user", "x")]  # its base is not there, and its h passes its own turns or not: either way one root
    assert found_trie(spark.createDataFrame(alone, "conv_id long, turn long, role string, text string")) == trie(alone)


def test_running_totals_cross_partitions(spark):
    rng = np.random.default_rng(5)
    keys = np.sort(rng.choice([1, 2, 2, 2, 2, 5, 9], 4000))
    values = rng.integers(0, 1 << 60, 4000)
    df = own.cut(spark.createDataFrame([(int(k), int(v), i) for i, (k, v) in enumerate(zip(keys, values, strict=True))], "k long, v long, i long").repartitionByRange(7, "k", "i").sortWithinPartitions("k", "i"))
    prime, base = int(convtrie.PRIME), convtrie._BASE
    at, total, want = Counter(), Counter(), {}
    for i, (k, v) in enumerate(zip(keys.tolist(), values.tolist(), strict=True)):
        old = total[k]
        total[k] = (old + v * pow(base, at[k], prime)) % prime
        want[i] = (at[k], old, total[k])
        at[k] += 1
    assert {r.i: (r._at, r._b0, r._t0) for r in running(df, "k", ["v"], base).collect()} == want


def test_louds_bits():
    #      0 above all; 1, 2 its children; 3, 4 of 1; 5 of 4
    t = Louds(np.array([2, 2, 0, 0, 1, 0]))
    assert "".join("01"[int(b)] for b in t.bits) == "10" + "110" + "110" + "0" + "0" + "10" + "0"
    assert t.parents().tolist() == [-1, 0, 0, 1, 1, 4]
    assert t.degrees().tolist() == [2, 2, 0, 0, 1, 0]


# Vectors


def near(rows, k=5, every=50):
    """Of each query row: (query id, [(score to 12 digits, id)])."""
    ok = [(i, np.array(v, float)) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    width = Counter(len(v) for _, v in ok)
    width = min(width, key=lambda n: (-width[n], n)) if width else 0
    ok = [(i, v / np.abs(v).max()) for i, v in ok if len(v) == width]
    out = []
    for a, (q, x) in enumerate(ok):
        if q is not None and q % every == 0:
            all_ = [(-round(float(x @ y / math.sqrt(x @ x) / math.sqrt(y @ y)), 12), i is not None, i or 0, i) for b, (i, y) in enumerate(ok) if a != b]
            out.append((q, [(-s, i) for s, _, _, i in sorted(all_, key=lambda t: t[:3])[:k]]))
    return sorted(out, key=repr)


def found_near(df, **more):
    got = nearest(df, **more).collect()
    by = defaultdict(list)
    for r in got:
        by[r.query_id].append((r.rank, round(r.score, 12), r.vec_id))
    return by


VECTORS = "vec_id long, embedding array<double>, label int, row int, shard string, v int"


def test_awkward_vectors(spark):
    """Few enough to be searched whole: ties, copies, repeated ids, nulls, other lengths."""
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (50, [1.0, 0.1]), (50, [0.0, 1.0]), (7, [2.0, 0.0]), (9, [0.5, 0.0]), (8, [-1.0, 0.0]), (None, [3.0, 0.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (100, [1.0, 2.0, 3.0]), (11, [1e-300, 1e-300]), (12, [1e300, 1e300]), (-50, [0.3, 0.4])]
    df = spark.createDataFrame([(i, v, 1, 2, "s", 3) for i, v in rows], VECTORS).repartition(3)
    got, want = found_near(df), near(rows)
    assert sum(map(len, got.values())) == sum(len(x) for _, x in want)
    for q, best in want:
        for rank, (score, i) in enumerate(best, 1):
            assert (rank, pytest.approx(score, abs=1e-11), i) in got[q], (q, rank)
    few = df.where("vec_id in (0, 7)")
    assert found_near(few) == {0: [(1, 1.0, 7)]}
    for none in (df.where("false"), df.where("vec_id in (1, 2, 3)")):
        assert nearest(none).collect() == []


@pytest.mark.parametrize("copies", [0, 1200])
def test_nearest_reaches_its_recall(spark, copies):
    """Clustered vectors over many cells and shards, a third of them one vector; scores are exact, ties are by id."""
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((20, 32))
    v = (centres[rng.integers(0, 20, 3600)] + 0.7 * rng.standard_normal((3600, 32))).astype(np.float32)
    v[rng.choice(3600, copies, replace=False)] = v[0]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>").repartition(4)
    got = found_near(df, shard_bytes=1)
    x = v.astype(float)
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    hits = 0
    for q in range(0, 3600, 50):
        s = np.round(x @ x[q], 12)
        s[q] = -9
        want = np.lexsort((np.arange(3600), -s))[:5]
        hits += len({i for _, _, i in got[q]} & set(want.tolist()))
        assert all(abs(score - s[i]) < 1e-11 for _, score, i in got[q]) and [r for r, _, _ in got[q]] == [1, 2, 3, 4, 5]
    assert hits / (72 * 5) >= 0.95
    whole = found_near(df, sure=1 - 1e-12)
    assert all([i for _, _, i in whole[q]] == np.lexsort((np.arange(3600), -np.where(np.arange(3600) == q, -9, np.round(x @ x[q], 12))))[:5].tolist() for q in range(0, 3600, 50))


def test_kd_tree_and_quantile():
    rng = np.random.default_rng(2)
    points, asked = rng.standard_normal((1000, 6)), rng.standard_normal((20, 6))
    tree = Tree(points)
    assert sorted(np.concatenate(tree.leaves).tolist()) == list(range(1000)) and max(map(len, tree.leaves)) <= neighbours.LEAF
    q, leaf, far2 = tree.reached(asked, np.full(20, 1.5))
    for i in range(20):
        own_leaves = leaf[q == i]
        inside = np.flatnonzero(((points - asked[i]) ** 2).sum(axis=1) <= 1.5)
        assert set(inside) <= {p for n in own_leaves for p in tree.leaves[n].tolist()}
        assert (np.diff(far2[q == i]) >= 0).all()
    law = (rng.standard_normal((200_000, 12)) ** 2).sum(axis=1)
    assert abs((law <= chi_square_quantile(0.97, 12)).mean() - 0.97) < 0.003


# Tokens

A, B = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"


def aligned(rows):
    p = pair(A, B)
    out, count, best, links = [], Counter(), Counter(), []
    for t in rows:
        if not t or "▁" in t:
            out.append((0, 0, 0, 0, 0, 0, ""))
            links.append([])
            continue
        a, b = p.a.encode(" " + t, add_special_tokens=False).ids, p.b.encode(t)
        ends = [np.cumsum(size[ids]).tolist() for size, ids in ((p.a_bytes, a), (p.b_bytes, b))]
        starts = [[0, *e[:-1]] for e in ends]
        linked = [(a[i], b[j]) for i in range(len(a)) for j in range(len(b)) if starts[0][i] < ends[1][j] and starts[1][j] < ends[0][i]]
        groups, last = [], 0
        for e in sorted(set(ends[0]) & set(ends[1])):
            groups.append("|".join(",".join(str(x) for x, end in zip(ids, own_ends, strict=True) if last < end <= e) for ids, own_ends in zip((a, b), ends, strict=True)))
            last = e
        links.append(linked)
        count.update(linked)
        out.append((len(a), len(b), len(groups), len(linked), 0, 0, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    return [(*r[:4], sum(count[x] == best[x[1]] for x in own_links), sum(count[x] for x in own_links), r[6]) for r, own_links in zip(out, links, strict=True)]


def token_texts():
    rng = random.Random(6)
    parts = [" ", "  ", "\n", "\t", "a", "the", "don't", "'s", "é", "ß", "中文字", " ", "　", " ", "1", "23456", "...", "!", "\x85", "\x1c", "🙂", "<s>", "<|endoftext|>", "\x00", "ing", "\r\n", "​", "İ", "﻿"]
    out = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 20))) for _ in range(150)]
    return [*out, None, "", " ", "   ", "x ", " x", "a▁b", "a b" * 40, "a" * 3000, "中" * 400, out[0], out[0], cases.sentence(rng, 300), "퟿", "ab́cd"]


def test_alignment_of_awkward_texts(spark, monkeypatch):
    rows = token_texts()
    data = [(i, t, 1, "s", 5, 6) for i, t in enumerate(rows)]
    df = spark.createDataFrame(data, "doc_id long, text string, n int, segment string, chunk int, at int").repartition(3)
    want = aligned(rows)
    for size in (alignment.CHUNK_BYTES, 100):  # one chunk a task, and many
        monkeypatch.setattr(alignment, "CHUNK_BYTES", size)
        got = {r.doc_id: tuple(r)[2:] for r in align_tokens(df, carry=("doc_id", "chunk")).collect()}
        assert [got[i] for i in range(len(rows))] == want
    assert align_tokens(df.where("false"), carry=("doc_id",)).collect() == []
    none = align_tokens(df.where("text is null"), carry=("doc_id",)).collect()
    assert [tuple(r)[1:] for r in none] == [(0, 0, 0, 0, 0, 0, "")]


def test_tokens_do_not_cross_cuts():
    p = pair(A, B)
    assert p.cuts and not p.alters
    for t in filter(None, token_texts() * 4):
        if "▁" in t:
            continue
        data = np.frombuffer((" " + t).encode(), np.uint8)
        bounds = [0, *cut_places(data).tolist(), len(data)]
        segments = [data[a:b].tobytes().decode() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        a, b = p.encode(segments)
        assert sum(a, []) == p.a.encode(" " + t, add_special_tokens=False).ids
        assert sum(b, []) == p.b.encode(t)


def test_groups_of_long_segments():
    """Segments of more rows than are folded at once, and cut by batches."""
    rows = 50_000
    made = [(s, 2, g, n + 1 - g, n + 10 - g, True, True) for s, n in ((1, 3), (2, rows), (3, 2)) for g in range(1, n + 1)]
    batch = pa.RecordBatch.from_pylist([dict(zip(("seg", "n", "g", "a", "b", "new_a", "new_b"), r, strict=True)) for r in made])
    parts = [batch.slice(i, 7000) for i in range(0, len(made), 7000)]
    got = sorted(pa.Table.from_batches(list(alignment._gathered(2)(iter(parts)))).to_pylist(), key=lambda r: r["seg"])
    # rows come last first: groups are numbered from the end
    assert [(r["seg"], r["n"], len(r["link_a"])) for r in got] == [(1, 2, 3), (2, 2, rows), (3, 2, 2)]
    for r in got:
        ids, marks, bounds = alignment.unpacked(pa.array([r["groups"]], pa.binary()), 2)
        n = int(bounds[1]) // 2
        assert ids[::2].tolist() == list(range(1, n + 1)) and ids[1::2].tolist() == [i + 9 for i in range(1, n + 1)] and r["link_a"] == ids[::2].tolist()
        assert "".join(alignment.MARKS[m] for m in marks) == ";".join(["|"] * n)


@pytest.mark.parametrize("width", [2, 4])
def test_packed_ids_come_back(width):
    rng = np.random.default_rng(3)
    n = rng.integers(0, 12, 300)
    bounds = np.append(0, np.cumsum(n))
    ids, marks = rng.integers(0, 1 << (8 * width - 1), bounds[-1]), rng.integers(0, 4, bounds[-1])
    got = alignment.unpacked(alignment.packed(ids, marks, bounds, width), width)
    assert all((x == y).all() for x, y in zip(got, (ids, marks, bounds), strict=True))
    numbers = rng.integers(0, 1 << 32, bounds[-1])
    back, at = alignment.unplaned(alignment.planes(numbers, bounds))
    assert (back == numbers).all() and (at == bounds).all()
