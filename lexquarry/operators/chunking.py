"""Elements to chunks: articles in pieces, table rows cut off, neighbouring paragraphs packed up to a limit.

Packing is a greedy fold whose state depends on the lengths seen, so a document's elements, in order, go through
one Python pass in Arrow batches, of which one pack of paragraphs is kept; everything around it is columns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexquarry.types import LOCATION

#: Where a long text may be cut, in this order, and what opens a sub-article.
SEPARATORS = ("。", "！", "？", "；", "\n")
_SUB = re.compile(r"（[一二三四五六七八九十]+）")


def packed(parts: list[str], limit: int) -> Iterator[str]:
    """Joins consecutive parts while they fit; a longer one stands alone."""
    held = ""
    for part in parts:
        if held and len(held) + len(part) > limit:
            yield held
            held = part
        else:
            held += part
    if held:
        yield held


def split_text(text: str, limit: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most `limit` characters, cut at the first separator that helps. Every segment of a cut text ends in the separator, also the last."""
    pieces = [text]
    for mark in separators:
        if all(len(p) <= limit for p in pieces):
            return pieces
        pieces = [q for p in pieces for q in ([p] if len(p) <= limit or mark not in p else packed([s + mark for s in p.split(mark) if s], limit))]
    return [p[i : i + limit] for p in pieces for i in (range(0, len(p), limit) if len(p) > limit else (0,))] if any(len(p) > limit for p in pieces) else pieces


def split_article(text: str, limit: int) -> list[str]:
    """An article as it is, or cut before its sub-articles, or as any text."""
    if len(text) <= limit:
        return [text]
    cuts = [0, *(m.start() for m in _SUB.finditer(text)), len(text)]
    parts = [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    if len(parts) == 1:
        return split_text(text, limit)
    return [p for part in packed(parts, limit) for p in (split_text(part, limit) if len(part) > limit else [part])]


class Packing:
    """The fold over a document's elements in order. Its state is one pack of paragraphs, with the place of the element that locates it."""

    def __init__(self, limit: int):
        self.limit, self.held, self.at = limit, "", None

    def add(self, kind: str, text: str, at) -> Iterator[tuple[object, str, str]]:
        """(place, suffix, text) of the chunks that an element completes."""
        if kind == "paragraph":
            if self.held and len(self.held) + len(text) > self.limit:
                yield self.at, "", self.held
                self.held, self.at = text, at
            else:
                self.held, self.at = (f"{self.held}\n{text}", self.at) if self.held else (text, at if self.at is None else self.at)
            return
        yield from self.end()
        if kind == "article":
            yield from ((at, str(j), piece) for j, piece in enumerate(split_article(text, self.limit)))
        elif kind == "table_row":
            yield at, "", text[: 2 * self.limit]

    def end(self) -> Iterator[tuple[object, str, str]]:
        if self.held:
            yield self.at, "", self.held
        self.held, self.at = "", None


def fold(kinds: list[str], texts: list[str], limit: int) -> Iterator[tuple[int, str, str]]:
    """(place of the element that locates it, suffix, text) of each chunk of a document's elements."""
    pack = Packing(limit)
    for i, (kind, text) in enumerate(zip(kinds, texts, strict=True)):
        yield from pack.add(kind, text, i)
    yield from pack.end()


def _folded(key: str, limit: int):
    """For mapInArrow over (key, kind, text, location) by document, in order: the chunks, whatever batches a document is in."""

    def run(batches):
        pack, now, no, kept = Packing(limit), None, 0, None  # kept: the location of the pack, if it began in an earlier batch
        for batch in batches:
            if not batch.num_rows:
                continue
            places = batch.column(3)
            source = places if kept is None else pa.concat_arrays([kept, places])
            first = len(source) - len(places)
            pack.at = None if pack.at is None else 0
            out: list[tuple] = []
            for i, (doc, kind, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)):
                done = list(pack.end()) if (doc,) != now else []
                out += ((now[0], no + j, *x) for j, x in enumerate(done))
                if (doc,) != now:
                    now, no = (doc,), 0
                found = list(pack.add(kind, text, first + i))
                out += ((doc, no + j, *x) for j, x in enumerate(found))
                no += len(found)
            yield _chunks(out, source, key, batch.schema)
            kept = None if pack.at is None else pa.concat_arrays([source.slice(pack.at, 1)])
        if now is not None:
            yield _chunks([(now[0], no + j, 0, *x[1:]) for j, x in enumerate(pack.end())], kept, key, batch.schema)

    return run


def _chunks(rows: list[tuple], places: pa.Array, key: str, schema: pa.Schema) -> pa.RecordBatch:
    doc, no, at, suffix, text = zip(*rows, strict=True) if rows else ((),) * 5
    location = places.take(pa.array(at, pa.int64())) if rows else pa.array([], schema.field(3).type)
    return pa.RecordBatch.from_arrays([pa.array(doc, schema.field(0).type), pa.array(no, pa.int32()), pa.array(suffix, pa.string()), pa.array(text, pa.string()), location], [key, "chunk_no", "suffix", "text", "location"])


def chunk_id(doc_id: Column, loc: Column, suffix: Column, text: Column) -> Column:
    """Sixteen hex digits over document, place, suffix and text; absent fields read None."""
    shown = [F.coalesce(loc[f].cast("string"), F.lit("None")) for f in ("article_no", "paragraph_seq", "sheet_name", "row_range")]
    joined = F.concat_ws("|", doc_id, *shown, suffix, text)
    return F.substring(F.sha1(F.encode(joined, "UTF-8")), 1, 16)


def chunks_of(elements: DataFrame, *, key: str = "doc_id", limit: int = 400) -> DataFrame:
    """key, chunk_no (from 0), suffix, text and location of the chunks of elements (key, seq, kind, text, location)."""
    kind = elements.schema[key].dataType.simpleString()
    rows = elements.select(key, "seq", "kind", F.coalesce("text", F.lit("")).alias("text"), F.col("location").cast(LOCATION).alias("location"))
    # a document is read in order, not gathered: its rows are sorted, with spilling, and go through in batches
    rows = rows.repartition(key).sortWithinPartitions(key, "seq", "kind", "text").select(key, "kind", "text", "location")
    return rows.mapInArrow(_folded(key, limit), f"`{key}` {kind}, chunk_no int, suffix string, text string, location {rows.schema['location'].dataType.simpleString()}")


def build_chunks(elements: DataFrame, registry: DataFrame, *, limit: int = 400) -> DataFrame:
    """Chunks with their document's fields, citation grade and id; chunk_ix orders them through the corpus."""
    from lexquarry.functions.citations import citation_level

    have = lambda c, kind, default=None: (F.col(c) if c in registry.columns else F.lit(default)).cast(kind).alias(c)
    docs = registry.select("doc_id", have("doc_version", "string", ""), F.element_at(F.split("file_path", "/"), -1).alias("file_name"), F.coalesce("doc_title", F.lit("")).alias("doc_title"), "format", have("effective_date", "string"), have("source_url", "string"), F.coalesce(have("is_latest", "int", 1), F.lit(1)).alias("is_latest"))
    out = chunks_of(elements, limit=limit).join(docs, "doc_id")
    out = out.withColumn("chunk_id", chunk_id(F.col("doc_id"), F.col("location"), F.col("suffix"), F.col("text")))
    out = out.withColumn("citation_level", citation_level(F.col("file_name"), F.col("doc_title"), F.col("format"), F.col("location")))
    return out.withColumn("chunk_ix", F.struct("doc_id", "chunk_no"))
