"""A prefix trie of conversations: every distinct beginning is a node, with what its subtree adds up to.

1. Turns are labelled by SHA-256 of role and text, so texts are never shuffled, and sorted in ranges that may cut a
   conversation anywhere. A beginning is known by its length and two polynomials of its labels, which are running
   totals: each partition's last run is carried into the next, so no conversation has to fit a task.
2. Nodes with more than shard_rows turns at and below them are the heavy upper levels. Everything below belongs to a
   shard: the subtree of the first node of a conversation that is not heavy.
3. Each shard becomes a level-order (LOUDS) bit vector with arrays of labels; parents and degrees are read from the
   bits, and rollups go through the levels from the last to the first by add.at.
4. Heavy levels are merged by Spark: every heavy node and every shard's root is counted once, at its smallest member;
   totals of a member from a depth downwards are running totals again, and their sum over members is the node's.

Cases. Null roles and texts are empty. Rows of a null conv_id take no part. Turns that tie are ordered by the SHA-256
of the role's length, a colon, role and text; rows that repeat are turns of their own. An empty table has no node,
not even a root. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexquarry.llm.spark import cut, small
from lexquarry.llm.textnum import _BACK, _BASE, PRIME, U64, reduced, residues, times

#: A node with more turns at and below it is heavy.
SHARD_ROWS = 512
#: Rows of complete shards that are built at once.
AT_ONCE = 8192
#: A group's other conversations may begin with so many turns of its first one, less one (see borrowed()).
BORROW = (5, 9)
_EMPTY = hashlib.sha256(b"").hexdigest()


def _longs(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64, copy=False) for n in names]


# Running totals within runs of equal keys, over sorted partitions


def _fold(key: np.ndarray, values: list[np.ndarray], state, base: int):
    """Places and running totals (before, through) of value * base**place modulo PRIME, within runs of a key; state: (key, rows, totals) so far."""
    n = len(key)
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    start = np.repeat(first, np.diff(np.append(first, n)))
    lead = slice(0, int(first[1]) if len(first) > 1 else n)
    open_ = state is not None and state[0] == key[0]
    at = np.arange(n) - start
    step = residues(base, n)[at]
    if open_:
        step[lead] = times(step[lead], np.full(lead.stop, pow(base, state[1], int(PRIME)), np.uint64))
    before, through = [], []
    for i, value in enumerate(values):
        term = times(value.astype(np.uint64), step)
        parts = []
        for part in (term & U64(0xFFFFFFFF), term >> U64(32)):
            total = np.cumsum(part, dtype=np.uint64)
            parts.append(total - (total - part)[start])
        total = reduced(times(reduced(parts[1]), np.full(n, 1 << 32, np.uint64)) + reduced(parts[0]))
        if open_:
            total[lead] = reduced(total[lead] + U64(state[2][i]))
        through.append(total)
        before.append(reduced(total + (PRIME - term)))
    if open_:
        at[lead] += state[1]
    return at, before, through, (int(key[-1]), int(at[-1]) + 1, [int(t[-1]) for t in through])


def running(df: DataFrame, key: str, columns: list[str], base: int = 1) -> DataFrame:
    """df, cut and sorted by key over its partitions, with _at (a row's place in its key) and for each column what its running total was before (_b0, _b1, ..) and is now (_t0, ..).

    Totals are of value * base**_at modulo PRIME; of base 1 they are plain sums as long as these stay below 2**61 - 1.
    One row a partition goes through the driver.
    """
    from pyspark import TaskContext

    def runs(batches):
        state, first, single = None, None, True
        for batch in batches:
            if batch.num_rows:
                k, *values = _longs(batch, key, *columns)
                first = int(k[0]) if first is None else first
                single = single and bool((k == first).all())
                state = _fold(k, values, state, base)[3]
        if state is not None:
            cells = [[TaskContext.get().partitionId()], [first], [single], [state[0]], [state[1]], [state[2]]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, (pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.int64())), strict=True)], ["part", "first", "single", "last", "n", "totals"])

    state, before = None, {}
    for r in sorted(df.select(key, *columns).mapInArrow(runs, "part int, first long, single boolean, last long, n long, totals array<long>").collect()):
        before[r["part"]] = state
        if state is not None and r["single"] and state[0] == r["first"]:
            step = pow(base, state[1], int(PRIME))
            state = (r["last"], state[1] + r["n"], [(a + b * step) % int(PRIME) for a, b in zip(state[2], r["totals"], strict=True)])
        else:
            state = (r["last"], r["n"], r["totals"])

    def totals(batches):
        state = before.get(TaskContext.get().partitionId())
        for batch in batches:
            if batch.num_rows:
                k, *values = _longs(batch, key, *columns)
                at, old, new, state = _fold(k, values, state, base)
                more = [at, *(x.view(np.int64) for x in (*old, *new))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, pa.int64()) for x in more)], [*batch.schema.names, *names])

    names = ["_at", *(f"_b{i}" for i in range(len(columns))), *(f"_t{i}" for i in range(len(columns)))]
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in df.schema), *(f"{n} long" for n in names)])
    return df.mapInArrow(totals, schema)


# Beginnings of conversations


def _labelled(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    role, text = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    number = lambda i: F.conv(F.substring("digest", i, 15), 16, 10).cast("long")
    rows = df.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.octet_length(text).cast("long").alias("size"), digest.alias("digest"))
    order = ("conv_id", F.col("turn").asc_nulls_first(), "l1", "l2")
    rows = rows.select("conv_id", "turn", "size", number(1).alias("l1"), number(16).alias("l2"))
    # rows that repeat are dealt over partitions too
    rows = rows.withColumn("salt", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(*order, "salt").sortWithinPartitions(*order, "salt").select("conv_id", "size", "l1", "l2")
    return running(cut(rows), "conv_id", ["l1", "l2"], _BASE).select("conv_id", F.col("_at").alias("at"), "size", *(F.col(a).alias(b) for a, b in (("_t0", "p1"), ("_t1", "p2"), ("_b0", "q1"), ("_b1", "q2"))))


def _moved(batches):
    """Own turns after their first h, put after what is borrowed."""
    for batch in batches:
        at, h, taken, p1, p2, q1, q2, s1, s2, o1, o2 = _longs(batch, "at", "h", "taken", "p1", "p2", "q1", "q2", "s1", "s2", "o1", "o2")
        back = np.array([pow(_BACK, i, int(PRIME)) for i in range(int((h - taken).max(initial=0)) + 1)], np.uint64)[h - taken]
        place = lambda x, o, s: reduced(times(reduced(x.astype(np.uint64) + (PRIME - o.astype(np.uint64))), back) + s.astype(np.uint64))  # noqa: E731,B023
        out = [place(p1, o1, s1), place(p2, o2, s2), place(q1, o1, s1), place(q2, o2, s2)]
        columns = [batch.column("conv_id"), pa.array(taken + at - h + 1), batch.column("len"), batch.column("size"), *(pa.array(x.view(np.int64)) for x in out)]
        yield pa.RecordBatch.from_arrays(columns, ["conv_id", "depth", "len", "size", "p1", "p2", "q1", "q2"])


def beginnings(df: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", borrow: tuple[int, int] | None = BORROW) -> tuple[DataFrame, DataFrame]:
    """Every beginning of one turn or more of every conversation, and (conv_id, len) of all.

    borrow (g, m): conversation c is rebuilt: the first h turns of conversation c - c % g, then its own after its first
    h, where h is the unsigned CRC-32 of c in decimal, modulo m. None: conversations as they are.
    A beginning has conv_id, depth, len (of the conversation), size (of its last text), p1 and p2 (of itself) and q1
    and q2 (of the one that is a turn shorter).
    """
    turns = _labelled(df, conv, turn, role, text)
    group, most = borrow or (1, 1)
    head = F.struct("at", "p1", "p2", "q1", "q2", "size")
    heads = turns.groupBy("conv_id").agg((F.max("at") + 1).alias("n"), F.array_sort(F.collect_list(F.when(F.col("at") < most - 1, head))).alias("heads"))
    if borrow is None:
        all_ = heads.select("conv_id", F.col("n").alias("len"))
        return turns.join(all_, "conv_id").select("conv_id", (F.col("at") + 1).alias("depth"), "len", "size", "p1", "p2", "q1", "q2"), all_
    heads = cut(heads)
    base = heads.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"), F.col("heads").alias("base_heads"))
    all_ = heads.withColumn("base", F.col("conv_id") - F.col("conv_id") % group).join(base, "base", "left")
    all_ = all_.withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % most)
    all_ = all_.withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0)))).withColumn("len", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    all_ = cut(all_.withColumn("base_heads", F.when(F.col("taken") > 0, F.slice("base_heads", 1, F.col("taken").cast("int")))))
    shared = all_.select("conv_id", "len", F.explode("base_heads").alias("b")).select("conv_id", (F.col("b.at") + 1).alias("depth"), "len", "b.size", "b.p1", "b.p2", "b.q1", "b.q2")
    last = lambda heads, n, field: F.coalesce(F.try_element_at(heads, F.when(F.col(n) > 0, F.col(n).cast("int")))[field], F.lit(0))
    own = all_.where("n > h").select("conv_id", "h", "taken", "len", last("base_heads", "taken", "p1").alias("s1"), last("base_heads", "taken", "p2").alias("s2"), last("heads", "h", "p1").alias("o1"), last("heads", "h", "p2").alias("o2"))
    own = turns.join(own, "conv_id").where("at >= h").mapInArrow(_moved, "conv_id long, depth long, len long, size long, p1 long, p2 long, q1 long, q2 long")
    return shared.unionByName(own), all_.select("conv_id", "len")


# Shards


class Louds:
    """A level-order unary degree sequence: for each node, in level order, as many ones as it has children and a zero, after a first 10 for the node that stands above all."""

    def __init__(self, degrees: np.ndarray):
        zeros = np.cumsum(degrees) + np.arange(len(degrees)) + 2
        self.bits = np.ones(int(degrees.sum()) + len(degrees) + 2, bool)
        self.bits[1] = False
        self.bits[zeros] = False
        self.ones, self.zeros = np.flatnonzero(self.bits), np.flatnonzero(~self.bits)

    def parents(self) -> np.ndarray:
        """The node above each (of the first: -1): zeros before its one, less one."""
        return self.ones - np.arange(len(self.ones)) - 1

    def degrees(self) -> np.ndarray:
        return np.diff(self.zeros) - 1


def _build(rows: pa.Table, out: list[str]) -> pa.RecordBatch:
    """The nodes of complete shards, as one trie under a node of its own."""
    root, r1, r2, depth, p1, p2, conv, length, size, q1, q2, above = _longs(rows, "root", "r1", "r2", "depth", "p1", "p2", "conv_id", "len", "size", "q1", "q2", "above")
    order = np.lexsort((depth, conv, r2, r1, root))
    root, r1, r2, depth, p1, p2, conv, length, size, q1, q2, above = (x[order] for x in (root, r1, r2, depth, p1, p2, conv, length, size, q1, q2, above))
    # rows of a node together, its smallest member first
    by = np.lexsort((conv, p2, p1, depth))
    new = np.append(True, (np.diff(depth[by]) != 0) | (np.diff(p1[by]) != 0) | (np.diff(p2[by]) != 0))
    node = np.empty(len(by), np.int64)
    node[by] = np.cumsum(new) - 1
    rep = by[new]
    n = len(rep)
    members = np.bincount(node, minlength=n)
    top = depth[rep] == root[rep]
    up = np.where(top, -1, node[rep - 1])  # a conversation's row before is the node above
    # level order: by level, then by the place of the node above, then by label
    level = depth[rep] - root[rep]
    place, ends, done = np.zeros(n, np.int64), [], 0
    by_level = np.argsort(level, kind="stable")
    bounds = np.searchsorted(level[by_level], np.arange(int(level.max()) + 2))
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        own = by_level[a:b]
        own = own[np.lexsort((p2[rep[own]], p1[rep[own]], place[up[own]] if a else np.zeros(b - a)))]
        place[own] = np.arange(done + 1, done + 1 + len(own))
        done += len(own)
        ends.append(done + 1)
    at = np.argsort(place)  # nodes in level order, the one above all left out
    degrees = np.bincount(np.append(0, place)[up + 1], minlength=n + 1)
    trie = Louds(degrees)
    parents, degrees = trie.parents(), trie.degrees()
    saved = np.append(0, (members[at] - 1) * size[rep[at]])
    leaves = (degrees == 0).astype(np.int64)
    for a, b in zip([1, *ends[:-1]][::-1], ends[::-1], strict=True):
        np.add.at(saved, parents[a:b], saved[a:b])
        np.add.at(leaves, parents[a:b], leaves[a:b])
    label = rep[at]
    parent = np.where(parents[1:] > 0, conv[label][parents[1:] - 1], above[label])
    digests = [_EMPTY] * n
    last = np.flatnonzero(depth == length)
    last = last[np.lexsort((conv[last], place[node[last]]))]
    where = place[node[last]] - 1
    for group in np.split(np.arange(len(last)), np.flatnonzero(np.diff(where)) + 1):
        if len(group):
            digests[where[group[0]]] = hashlib.sha256(",".join(map(str, conv[last[group]].tolist())).encode()).hexdigest()
    columns = [conv[label], depth[label], parent, members[at], degrees[1:], leaves[1:], saved[1:], q1[label], q2[label]]
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array(digests, pa.string()), pa.array(parents[1:] == 0)], out)


def _shards(out: list[str]):
    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= AT_ONCE:
                rows = pa.Table.from_batches(held)
                key = np.stack(_longs(rows, "root", "r1", "r2"))
                start = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0))
                if len(start):
                    yield _build(rows.slice(0, int(start[-1]) + 1), out)
                    rows = rows.slice(int(start[-1]) + 1).combine_chunks()
                held, n = rows.to_batches(), 0 if not len(start) else rows.num_rows
        if sum(b.num_rows for b in held):
            yield _build(pa.Table.from_batches(held), out)

    return run


# Heavy levels


def _pieces(batches):
    """Members of a node that stand together, as text."""
    for batch in batches:
        depth, p1, p2, conv = _longs(batch, "depth", "p1", "p2", "conv_id")
        if len(conv):
            start = np.flatnonzero(np.append(True, (np.diff(depth) != 0) | (np.diff(p1) != 0) | (np.diff(p2) != 0)))
            text = [",".join(map(str, x.tolist())) for x in np.split(conv, start[1:])]
            yield pa.RecordBatch.from_arrays([*(pa.array(x[start]) for x in (depth, p1, p2, conv)), pa.array(text, pa.string())], ["depth", "p1", "p2", "first", "piece"])


def _digested(batches):
    now, sha = None, None
    row = lambda: pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in now), pa.array([sha.hexdigest()])], ["depth", "p1", "p2", "ends"])
    for batch in batches:
        for *key, piece in zip(*(batch.column(n).to_pylist() for n in ("depth", "p1", "p2", "piece")), strict=True):
            if key != now:
                if now is not None:
                    yield row()
                now, sha = key, hashlib.sha256(piece.encode())
            else:
                sha.update(b"," + piece.encode())
    if now is not None:
        yield row()


def _ends(members: DataFrame) -> DataFrame:
    """depth, p1, p2 and the digest of the members that end there, in order; ids are joined where they lie, so the one task of a node reads few long rows and keeps none."""
    node = ("depth", "p1", "p2")
    rows = members.repartitionByRange(*node, "conv_id").sortWithinPartitions(*node, "conv_id").select(*node, "conv_id")
    pieces = rows.mapInArrow(_pieces, "depth long, p1 long, p2 long, first long, piece string")
    return pieces.repartition(*node).sortWithinPartitions(*node, "first").select(*node, "piece").mapInArrow(_digested, "depth long, p1 long, p2 long, ends string")


def conversation_trie(df: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", borrow: tuple[int, int] | None = BORROW, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row a node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    n_leaves: nodes without children at and below it. saved_tokens: over all nodes at and below it, bytes of the last
    text times members less one. ends_sha256: of the members that end there, ids in ascending order, comma-joined.
    """
    node = ["depth", "p1", "p2"]
    rows, convs = beginnings(df, conv=conv, turn=turn, role=role, text=text, borrow=borrow)
    rows = cut(rows)
    root = convs.agg(F.count("*").alias("n"), F.min("conv_id").alias("rep")).first()
    below = F.sum(F.col("len") - F.col("depth") + 1)
    heavy = rows.groupBy(*node).agg(below.alias("below"), F.count("*").alias("n"), F.min("conv_id").alias("rep"), *(F.first(c).alias(c) for c in ("size", "q1", "q2"))).where(F.col("below") > shard_rows).drop("below")
    heavy = small(heavy)
    in_heavy = cut(rows.join(heavy.select(*node, "rep"), node).select("conv_id", "len", *node, "rep"))
    lowest = small(in_heavy.groupBy("conv_id").agg(F.max(F.struct("depth", "rep")).alias("low")).select("conv_id", F.col("low.depth").alias("low"), F.col("low.rep").alias("above")))
    # a conversation's shard: its first node that is not heavy
    first = rows.join(lowest, "conv_id", "left").where(F.col("depth") == F.coalesce("low", F.lit(0)) + 1)
    first = first.select("conv_id", F.col("depth").alias("root"), F.col("p1").alias("r1"), F.col("p2").alias("r2"), F.coalesce("above", F.lit(root["rep"])).alias("above"))
    light = rows.join(first, "conv_id").where("depth >= root")
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "q1", "q2", "ends_sha256", "is_root"]
    light = light.repartition("root", "r1", "r2").sortWithinPartitions("root", "r1", "r2").mapInArrow(_shards(names), ", ".join(f"{n} long" for n in names[:9]) + ", ends_sha256 string, is_root boolean")
    light = cut(light)

    tops = light.where("is_root")
    children = heavy.select((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2")).unionByName(tops.select((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2")))
    children = cut(children.groupBy(*node).agg(F.count("*").alias("n_children")))
    heavy = cut(heavy.join(children, node, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    own = heavy.select(F.col("rep").alias("conv_id"), "depth", (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n") - 1) * F.col("size")).alias("saved"))
    parts = cut(own.unionByName(tops.select("conv_id", "depth", F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))))
    whole = parts.agg(F.coalesce(F.sum("leaves"), F.lit(0)).alias("leaves"), F.coalesce(F.sum("saved"), F.lit(0)).alias("saved")).first()
    # what a shard right under the root adds, it adds to the root alone
    parts = parts.join(lowest.select("conv_id"), "conv_id", "left_semi").select("conv_id", "depth", F.lit(0).alias("asks"), "leaves", "saved", F.lit(0).cast("long").alias("p1"), F.lit(0).cast("long").alias("p2"))
    asking = in_heavy.select("conv_id", "depth", F.lit(1).alias("asks"), F.lit(0).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"), "p1", "p2")
    order = ("conv_id", F.desc("depth"), "asks")
    totals = running(cut(parts.unionByName(asking).repartitionByRange(*order).sortWithinPartitions(*order)), "conv_id", ["leaves", "saved"])
    totals = totals.where("asks = 1").groupBy(*node).agg(F.sum("_t0").alias("n_leaves"), F.sum("_t1").alias("saved_tokens"))
    empty = convs.where("len = 0").select(F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("p1"), F.lit(0).cast("long").alias("p2"), "conv_id")
    ends = cut(_ends(in_heavy.where("len = depth").select(*node, "conv_id").unionByName(empty)))
    above = small(heavy.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("rep").alias("parent_conv_id")))
    out = heavy.join(totals, node).join(ends, node, "left").join(above, ["depth", "q1", "q2"], "left")
    result = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    digest = F.coalesce("ends", F.lit(_EMPTY)).alias("ends_sha256")
    out = out.select(F.col("rep").alias("conv_id"), "depth", F.coalesce("parent_conv_id", F.lit(root["rep"])).alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", digest)
    if not root["n"]:
        return light.select(*result)
    spark = df.sparkSession
    first = spark.createDataFrame([(root["rep"], 0, None, root["n"], max(0, whole["leaves"]), whole["saved"])], "conv_id long, depth long, parent_conv_id long, n_convs long, n_leaves long, saved_tokens long")
    first = first.join(children.where("depth = 0").select("depth", "n_children"), "depth", "left").join(ends.where("depth = 0").select("depth", "ends"), "depth", "left")
    first = first.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.greatest("n_leaves", F.lit(1)).alias("n_leaves"), "saved_tokens", digest)
    return light.select(*result).unionByName(out.select(*result)).unionByName(first.select(*result))
