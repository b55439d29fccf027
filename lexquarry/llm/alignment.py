"""Alignment of two tokenizers' tokens over a corpus, by byte offsets.

1. Texts are cut before every single space that follows a mark: no token of either tokenizer crosses such a place, so
   a segment's tokens are the same wherever it stands. Each chunk of texts (CHUNK_BYTES) lists its segments once and
   writes its documents as numbers into that list.
2. Each distinct segment of the corpus is encoded once. Tokens are exploded with their positions, their ends are
   running sums of byte lengths, and both sides are joined by segment and end. The rows between two ends are the links:
   the token that covers them on either side is the next one to end. Running counts of the common ends number the groups.
3. Counts of id pairs are sums over segments, times how often each occurs; links then look up their pair's count.
4. Segments' figures go back to the chunks that list them, where documents add them up.

Links are the rows of the outer join rather than a range join within groups: a link's overlap holds no end but its own,
so there is one row a link, while a long group would pair each of its tokens with each.

Cases. Texts that are null, empty, or hold U+2581 (or what else the second tokenizer alters) have no tokens: zeros, and
'' for groups_sha256. Other strings of special tokens are plain text. Rows that repeat, and null ids, are documents of
their own. Empty tables give empty results. A text is one row, and one segment if it has no space: what is held at once
is a chunk, or the longest text.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexquarry.llm.spark import conf, dropped, kept, prepare, small
from lexquarry.llm.textnum import buffers

TOKENIZERS = "/opt/tokenizers"
#: Bytes of text that share a list of segments.
CHUNK_BYTES = 32 << 20
MARK = "▁"


class Pair:
    """The two tokenizers: a byte-level one (A), and one of pieces with byte fallback (B), which puts a space before a text."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        with open(a_path, encoding="utf-8") as f:
            first = json.load(f)["pre_tokenizer"]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        # a space begins a token of A that no mark stands in before it; no piece of B holds a space after something else
        self.cuts = first["type"] == "ByteLevel" and first.get("use_regex", True) and not any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces)
        size = self.a.get_vocab_size()
        self.a_bytes = np.array([len(self.a.id_to_token(i) or "") for i in range(size)], np.int64)  # a character of its alphabet is a byte
        self.b_bytes = np.array([1 if re.fullmatch("<0x[0-9A-F]{2}>", p) else len(p.replace(MARK, " ").encode()) for p in pieces], np.int64)
        self.space = self.b.piece_to_id(MARK)
        probe = "a  b　ﬁÅ ① Ａ\t\r\n é İ­​ "
        self.alters = self.b.normalize(probe) != MARK + probe.replace(" ", MARK)

    def whole(self, text: str) -> bool:
        """Whether B's tokens spell the text."""
        return MARK not in text and (not self.alters or self.b.normalize(text) == MARK + text.replace(" ", MARK))

    def encode(self, segments: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of segments, which begin with a space."""
        a = [e.ids for e in self.a.encode_batch(segments, add_special_tokens=False)]
        b = self.b.encode([s[1:] for s in segments], num_threads=1)
        return a, [x if s != " " else [self.space] for s, x in zip(segments, b, strict=True)]


@functools.lru_cache(maxsize=4)
def pair(a_path: str, b_path: str) -> Pair:
    return Pair(a_path, b_path)


def cut_places(data: np.ndarray) -> np.ndarray:
    """Places of spaces that follow a character which is no white space (what may be some counts as such)."""
    at = np.flatnonzero(data == 0x20).astype(np.int32)  # a column of text is below 2 GB
    at = at[at > 0]
    back = lambda n: np.where(at >= n, data[np.maximum(at - n, 0)], 0)
    x, y, z = back(1), back(2), back(3)
    mark = (x > 0x20) & (x != 0x7F)
    space = ((y == 0xC2) & ((x == 0x85) | (x == 0xA0))) | ((z == 0xE2) & ((y == 0x80) | (y == 0x81))) | ((z == 0xE1) & ((y == 0x9A) | (y == 0xA0))) | ((z == 0xE3) & (y == 0x80))
    return at[mark & ~space]


def planes(numbers: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Rows (by bounds) of numbers below 2**32 as bytes: how many, and, compressed, the lowest byte of each, then the next of each, and so on."""
    codec, out = pa.Codec("zstd", compression_level=3), []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        own = np.ascontiguousarray(numbers[a:b].astype("<u4").view(np.uint8).reshape(-1, 4).T)
        out.append((b - a).to_bytes(4, "little") + codec.compress(own, asbytes=True) if b > a else b"")
    return pa.array(out, pa.binary())


def unplaned(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and bounds of rows."""
    codec, out, n = pa.Codec("zstd"), [np.zeros(0, np.int64)], []
    for row in column.to_pylist():
        n.append(int.from_bytes(row[:4], "little"))
        if n[-1]:
            own = np.frombuffer(codec.decompress(row[4:], 4 * n[-1]), np.uint8).reshape(4, -1)
            out.append(np.ascontiguousarray(own.T).view("<u4").ravel().astype(np.int64))
    return np.concatenate(out), np.append(0, np.cumsum(n, dtype=np.int64))


def _numbered(paths: tuple[str, str]):
    """For mapInArrow over text and carried columns: documents as numbers of their chunk's segments, and the segments."""

    def chunk(number: int, rows: pa.Table) -> list[pa.RecordBatch]:
        tokenizers = pair(*paths)
        text = rows.column(0).combine_chunks()
        there = pc.fill_null(pc.greater(pc.binary_length(text), 0), False)
        if tokenizers.alters:
            there = pa.array([bool(t) and tokenizers.whole(t) for t in text.to_pylist()], pa.bool_())
        else:
            there = pc.and_(there, pc.fill_null(pc.invert(pc.match_substring(text, MARK)), False))
        data, offsets = buffers(pc.binary_join_element_wise("", pc.filter(text, there), " "))
        offsets = offsets.astype(np.int32)
        start = np.union1d(cut_places(data) if tokenizers.cuts else offsets[:0], offsets[:-1])
        segments = pa.StringArray.from_buffers(len(start), pa.py_buffer(np.append(start, np.int32(len(data)))), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
        at = segments.indices.to_numpy(zero_copy_only=False)
        n = np.bincount(at, minlength=len(segments.dictionary)) if len(at) else np.zeros(0, np.int64)
        # the most frequent get the least numbers, which take less room
        order = np.argsort(-n, kind="stable")
        number_of = np.empty(len(n), np.int32)
        number_of[order] = np.arange(len(n), dtype=np.int32)
        full = np.zeros(rows.num_rows, bool)
        full[there.to_numpy(zero_copy_only=False)] = True
        sizes = np.zeros(rows.num_rows, np.int64)
        sizes[full] = np.diff(np.searchsorted(start, offsets))
        ids = planes(number_of[at], np.append(0, np.cumsum(sizes)))
        none = lambda k, t: pa.nulls(k, t)
        k, m = rows.num_rows, len(n)
        docs = [pa.array(np.full(k, number)), ids, none(k, pa.string()), none(k, pa.int32()), none(k, pa.int64())]
        listed = [pa.array(np.full(m, number)), none(m, pa.binary()), segments.dictionary, pa.array(number_of), pa.array(n)]
        names = ["chunk", "ids", "segment", "at", "n", *rows.schema.names[1:]]
        docs += [rows.column(i).combine_chunks() for i in range(1, rows.num_columns)]
        listed += [none(m, rows.schema.types[i]) for i in range(1, rows.num_columns)]
        return [b for columns in (listed, docs) for b in pa.Table.from_arrays(columns, names).to_batches(10_000)]

    def run(batches):
        from pyspark import TaskContext

        held, size, number = [], 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            # a batch of long texts is cut further
            lengths = pc.fill_null(pc.binary_length(batch.column(0)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            part = (np.cumsum(lengths) + size) // CHUNK_BYTES
            bounds = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                held.append(batch.slice(a, b - a))
                size += int(lengths[a:b].sum())
                if size >= CHUNK_BYTES or b < batch.num_rows:
                    yield from chunk(number, pa.Table.from_batches(held))
                    held, size, number = [], 0, number + 1
        if held:
            yield from chunk(number, pa.Table.from_batches(held))

    return run


def _encoded(paths: tuple[str, str]):
    def lists(ids: list[list[int]], size: np.ndarray):
        flat = np.fromiter((i for x in ids for i in x), np.int32)
        offsets = pa.array(np.append(0, np.cumsum([len(x) for x in ids])).astype(np.int32))
        spans = size[flat]
        total = np.append(0, np.cumsum(spans))[offsets.to_numpy()]
        return pa.ListArray.from_arrays(offsets, pa.array(flat)), pa.ListArray.from_arrays(offsets, pa.array(spans.astype(np.int32))), np.diff(total)

    def run(batches):
        tokenizers = pair(*paths)
        for batch in batches:
            if batch.num_rows:
                segments = batch.column(0)
                a, b = tokenizers.encode(segments.to_pylist())
                (a, a_len, a_all), (b, b_len, b_all) = lists(a, tokenizers.a_bytes), lists(b, tokenizers.b_bytes)
                size = pc.binary_length(segments).to_numpy(zero_copy_only=False)
                if (a_all != size).any() or (b_all != size).any():
                    raise ValueError("a tokenizer does not spell its text")
                yield pa.RecordBatch.from_arrays([*batch.columns, a, a_len, b, b_len], ["segment", "n", "seg", "a", "a_len", "b", "b_len"])

    return run


#: What stands after an id in the text of groups.
MARKS = (",", "|", ";", "")


def packed(ids: np.ndarray, marks: np.ndarray, bounds: np.ndarray, width: int) -> pa.Array:
    """Rows (by bounds) of ids, each with the number of its mark, as bytes: the ids of a row, then four marks a byte."""
    n = np.diff(bounds)
    offsets = np.append(0, np.cumsum(n * width + -(-n // 4)))
    out = np.zeros(int(offsets[-1]), np.uint8)
    row = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(ids)) - bounds[:-1][row]
    at = offsets[:-1][row] + place * width
    for i in range(width):
        out[at + i] = (ids >> (8 * i)) & 0xFF
    np.bitwise_or.at(out, offsets[:-1][row] + n[row] * width + place // 4, (marks << (2 * (place % 4))).astype(np.uint8))
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(out)])


def unpacked(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, marks and bounds of rows."""
    data, offsets = buffers(column)
    n = 4 * np.diff(offsets) // (4 * width + 1)
    bounds = np.append(0, np.cumsum(n))
    row = np.repeat(np.arange(len(n)), n)
    place = np.arange(int(bounds[-1])) - bounds[:-1][row]
    at = offsets[:-1][row] + place * width
    ids = np.zeros(len(place), np.int64)
    for i in range(width):
        ids |= data[at + i].astype(np.int64) << (8 * i)
    return ids, (data[offsets[:-1][row] + n[row] * width + place // 4] >> (2 * (place % 4)).astype(np.uint8)).astype(np.int64) & 3, bounds


def _gathered(width: int):
    """For mapInArrow: rows of links, last first within a segment, to one row a segment: its links, and its ids group by group."""

    def segments(rows: pa.Table) -> pa.RecordBatch:
        number = lambda n: rows[n].to_numpy().astype(np.int64)[::-1]
        seg, n, group, a, b, new_a, new_b = (number(x) for x in ("seg", "n", "g", "a", "b", "new_a", "new_b"))
        first = np.flatnonzero(np.append(True, seg[1:] != seg[:-1]))
        # ids of A, then of B, group by group
        run = np.cumsum(np.append(True, (seg[1:] != seg[:-1]) | (group[1:] != group[:-1]))) - 1
        which = np.concatenate([np.flatnonzero(new_a), np.flatnonzero(new_b)])
        side = np.repeat([0, 1], [int(new_a.sum()), int(new_b.sum())])
        order = np.lexsort((which, side, run[which]))
        which, side = which[order], side[order]
        ends = lambda x: np.append(x[1:] != x[:-1], True)
        marks = np.where(ends(seg[which]), 3, np.where(ends(run[which]), 2, ends(side)))
        bounds = np.searchsorted(np.searchsorted(first, which, side="right") - 1, np.arange(len(first) + 1))
        groups = packed(np.where(side == 0, a[which], b[which]), marks, bounds, width)
        offsets = pa.array(np.append(first, len(seg)).astype(np.int32))
        links = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (a, b)]
        return pa.RecordBatch.from_arrays([pa.array(seg[first]), pa.array(n[first]), groups, *links], ["seg", "n", "groups", "link_a", "link_b"])

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= 20_000:
                all_ = pa.Table.from_batches(held)
                seg = all_["seg"].to_numpy()
                whole = np.flatnonzero(seg[1:] != seg[:-1])
                if len(whole):
                    yield segments(all_.slice(0, int(whole[-1]) + 1))
                    all_ = all_.slice(int(whole[-1]) + 1).combine_chunks()
                    held, rows = all_.to_batches(), all_.num_rows
                else:
                    rows = 0  # a segment of more rows than that: look again later
        if sum(b.num_rows for b in held):
            yield segments(pa.Table.from_batches(held))

    return run


#: What a document adds up.
FIGURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


class Listed:
    """A chunk's segments: their figures, and the text of their groups."""

    def __init__(self, rows: pa.Table, width: int):
        at = np.argsort(rows["at"].to_numpy(), kind="stable")
        packed_groups, texts, counts = rows["groups"].combine_chunks(), [], []
        for i in range(0, max(1, len(at)), 50_000):
            ids, marks, bounds = unpacked(packed_groups.take(pa.array(at[i : i + 50_000])), width)
            # A's ids stand before a group's bar, B's after it
            step = (marks == 1).astype(np.int64) - (marks >= 2)
            side = np.cumsum(step) - step
            counts.append([np.diff(np.append(0, np.cumsum(x))[bounds]) for x in (side == 0, side == 1, marks >= 2)])
            text = pc.binary_join_element_wise(pc.cast(pa.array(ids), pa.string()), pa.array(MARKS).take(pa.array(marks)), "")
            texts.append(pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), text), ""))
        n_a, n_b, n_groups = (np.concatenate(x) for x in zip(*counts, strict=True))
        # a link for each end, and a group for each end of both
        self.figures = [n_a, n_b, n_groups, n_a + n_b - n_groups, *(rows[f].to_numpy()[at] for f in FIGURES[4:])]
        self.groups = pa.concat_arrays(texts)


def _added(carry: list[str], width: int):
    """For mapInArrow: a chunk's segments come before its documents, which add up their figures."""

    def run(batches):
        now, held, listed = None, [], None
        for batch in batches:
            key, lists = batch.column("chunk").to_numpy(), batch.column("at").is_valid().to_numpy(zero_copy_only=False)
            change = np.flatnonzero(np.append(True, (np.diff(key) != 0) | (np.diff(lists.astype(np.int8)) != 0)))
            for i, j in zip(change, np.append(change[1:], len(key)), strict=True):
                part = batch.slice(i, j - i)
                if key[i] != now:
                    now, held, listed = key[i], [part.slice(0, 0).select(_LISTED)], None
                if lists[i]:
                    held.append(part.select(_LISTED))
                    continue
                listed = listed or Listed(pa.Table.from_batches(held), width)
                held = []
                flat, bounds = unplaned(part.column("ids"))
                sums = [np.diff(np.append(0, np.cumsum(f[flat]))[bounds]) for f in listed.figures]
                digests = []
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    sha = hashlib.sha256()
                    for at in range(a, b, 100_000):
                        piece = ";".join(listed.groups.take(pa.array(flat[at : min(b, at + 100_000)])).to_pylist())
                        sha.update((";" + piece if at > a else piece).encode())
                    digests.append(sha.hexdigest() if b > a else "")
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carry), *(pa.array(s, pa.int64()) for s in sums), pa.array(digests, pa.string())], [*carry, *(f"_{f}" for f in FIGURES), "_groups_sha256"])

    return run


_LISTED = ["at", "n_best", "count_sum", "groups"]


def linked_segments(encoded: DataFrame, width: int) -> DataFrame:
    """Of each segment (seg, n, a, a_len, b, b_len) its links and groups."""
    dealt = encoded.select("seg", "n", "a", "a_len", "b", "b_len").repartition("seg")

    def side(name: str) -> DataFrame:
        each = dealt.select("seg", "n", F.posexplode(F.arrays_zip(F.col(name).alias("id"), F.col(f"{name}_len").alias("len"))).alias("pos", "t"))
        end = F.sum("t.len").over(Window.partitionBy("seg").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
        return each.select("seg", F.col("n").alias(f"n_{name}"), end.alias("end"), F.col("t.id").alias(name))

    ends = side("a").join(side("b"), ["seg", "end"], "full")
    back = Window.partitionBy("seg").orderBy(F.desc("end")).rowsBetween(Window.unboundedPreceding, 0)
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    rows = ends.select(
        "seg", F.coalesce("n_a", "n_b").alias("n"), F.sum(both.cast("long")).over(back).alias("g"), F.last("a", ignorenulls=True).over(back).alias("a"), F.last("b", ignorenulls=True).over(back).alias("b"),
        F.col("a").isNotNull().alias("new_a"), F.col("b").isNotNull().alias("new_b"),
    )
    return rows.mapInArrow(_gathered(width), "seg long, n long, groups binary, link_a array<int>, link_b array<int>")


def align_tokens(df: DataFrame, *, text: str = "text", carry: tuple[str, ...] = (), folder: str = TOKENIZERS, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model") -> DataFrame:
    """carry, and of each text _n_a, _n_b, _n_groups, _n_links, _n_best, _count_sum and _groups_sha256.

    Groups: tokens between two offsets where both a token of A and one of B end. Links: pairs of tokens that overlap.
    A pair of ids counts how many links of all texts hold it; _n_best: links whose count is the highest of their B id;
    _count_sum: of the counts of the links.
    """
    spark = df.sparkSession
    prepare(spark)
    paths = (f"{folder}/{a}", f"{folder}/{b}")
    tokenizers = pair(*paths)
    width = 2 if max(len(tokenizers.a_bytes), len(tokenizers.b_bytes)) <= 1 << 16 else 4
    carried = [f"_c{i}" for i in range(len(carry))]
    source = df.select(F.col(text).cast("string").alias("text"), *(F.col(c).alias(n) for c, n in zip(carry, carried, strict=True)))
    kinds = "".join(f", {f.name} {f.dataType.simpleString()}" for f in source.schema[1:])
    chunks = kept(source.mapInArrow(_numbered(paths), f"chunk long, ids binary, segment string, at int, n long{kinds}"))
    listed, docs = chunks.where("at is not null").select("chunk", "at", "segment", "n"), chunks.where("at is null").select("chunk", "ids", *carried)

    segments = listed.groupBy("segment").agg(F.sum("n").alias("n")).withColumn("seg", F.monotonically_increasing_id())
    segments = kept(segments.mapInArrow(_encoded(paths), "segment string, n long, seg long, a array<int>, a_len array<int>, b array<int>, b_len array<int>"))
    # both sides are dealt by segment already: Spark then needs no further shuffle to join by segment and end
    with conf(spark, "spark.sql.requireAllClusterKeysForCoPartition", "false"):
        linked = kept(linked_segments(segments, width))

    link = F.explode(F.arrays_zip("link_a", "link_b"))
    pairs = kept(linked.select("n", link.alias("l")).groupBy("l.link_a", "l.link_b").agg(F.sum("n").alias("count")))
    best = pairs.groupBy("link_b").agg(F.max("count").alias("most"))
    pairs = small(pairs.join(small(best), "link_b").select("link_a", "link_b", "count", (F.col("count") == F.col("most")).cast("long").alias("best")))
    found = linked.select("seg", link.alias("l")).select("seg", "l.*").join(pairs, ["link_a", "link_b"])
    found = found.groupBy("seg").agg(F.sum("best").alias("n_best"), F.sum("count").alias("count_sum"))
    figures = kept(segments.select("seg", "segment").join(linked.select("seg", "groups"), "seg").join(found, "seg").drop("seg"))
    dropped(segments)
    dropped(linked)

    none = lambda kind: F.lit(None).cast(kind)
    known = listed.drop("n").join(figures, "segment").select("chunk", *_LISTED, none("binary").alias("ids"), *(none(chunks.schema[c].dataType).alias(c) for c in carried))
    asking = docs.select("chunk", none("int").alias("at"), none("long").alias("n_best"), none("long").alias("count_sum"), none("binary").alias("groups"), "ids", *carried)
    rows = known.unionByName(asking).repartition("chunk").sortWithinPartitions("chunk", F.col("at").asc_nulls_last())
    out = rows.mapInArrow(_added(carried, width), "".join(f"{c} {chunks.schema[c].dataType.simpleString()}, " for c in carried) + ", ".join(f"_{f} long" for f in FIGURES) + ", _groups_sha256 string")
    return out.select(*(F.col(n).alias(c) for c, n in zip(carry, carried, strict=True)), *(f"_{f}" for f in FIGURES), "_groups_sha256")
