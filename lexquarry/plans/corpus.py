"""From a folder of documents to a registry, to chunks, to an index, to answers: the stages put together."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexquarry.functions import dates
from lexquarry.functions.citations import citation
from lexquarry.functions.text import clean, decoded, fingerprint
from lexquarry.operators import chunking, registry, structure
from lexquarry.sources import files

META = ("file_path", "format", "size", "mtime", "content_hash")


def route(fmt: str) -> str:
    """The reader of a format: word, text, markdown or sheet."""
    reader = {"docx": "word", "doc": "word", "doc_converted": "word", "txt": "text", "md": "markdown", "xlsx": "sheet"}.get(fmt)
    if reader is None:
        raise ValueError(f"no reader for format {fmt!r}")
    return reader


def records(files_: DataFrame) -> DataFrame:
    """Registry records of files of one reader's format or several (sources.files.located, with content). Unreadable files have a status of ERROR.

    What is known of a file goes along through its reader, so contents are read once and never joined.
    """
    base = files_.select(registry.doc_id(F.col("file_path")).alias("doc_id"), *META[:-1], F.sha2("content", 256).alias("content_hash"), "content")
    of = lambda reader: F.col("format").isin(*(f for f in ("docx", "doc_converted", "txt", "xlsx") if route(f) == reader))
    none = F.lit(None).cast("string")
    name = F.element_at(F.split("file_path", "/"), -1)

    plain = base.where(of("text")).select("doc_id", *META, decoded(F.col("content")).alias("text"))
    text = files.text_header(plain, keep=META).select("doc_id", *META, "doc_title", "title_source", "effective_date", "issuing_org", "source_url", "body", F.lit("OK").alias("status"))

    word = files.read_word(base.where(of("word")), keep=META)
    line = F.when(F.col("kind") == "p", clean(F.get("cells", F.lit(0)))).otherwise(F.array_join(F.transform("cells", lambda c: clean(c)), " "))
    # paragraphs first, then table rows
    entry = F.struct((F.col("kind") != "p").alias("later"), "ord", "row", line.alias("line"), (F.col("kind") == "p").alias("p"))
    grouped = word.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.when(F.col("kind").isNotNull(), entry))).alias("all"), F.max("status").alias("status"), *(F.first(c).alias(c) for c in META))
    lines = F.transform(F.filter("all", lambda e: ~e["p"] | (e["line"] != "")), lambda e: e["line"])
    title, source = files.word_title(F.col("lines"))
    words = grouped.withColumn("lines", lines).select("doc_id", *META, title.alias("doc_title"), source.alias("title_source"), dates.effective_date(F.slice("lines", 1, 8)).alias("effective_date"), none.alias("issuing_org"), none.alias("source_url"), F.array_join("lines", "\n").alias("body"), "status")

    sheets = files.sheet_body(files.read_sheets(base.where(of("sheet")), keep=META), keep=META)
    sheets = sheets.select("doc_id", *META, F.regexp_replace(name, r"\.[^.]*$", "").alias("doc_title"), F.lit("filename").alias("title_source"), none.alias("effective_date"), none.alias("issuing_org"), none.alias("source_url"), "body", "status")

    out = text.unionByName(words).unionByName(sheets)
    return out.select(
        "doc_id", *META, F.substring("content_hash", 1, 8).alias("doc_version"), fingerprint(F.col("body")).alias("fingerprint"),
        "doc_title", "title_source", dates.resolved_date(F.col("format"), F.col("effective_date"), dates.file_name_date(name)).alias("effective_date"), "source_url", "issuing_org", "status",
    )


def build_registry(spark: SparkSession, root: str, known: DataFrame | None = None) -> DataFrame:
    """Registry records of the files below root that `known` doesn't hold unchanged; only those are opened."""
    paths = None
    if known is not None:  # the driver lists every file anyhow, to plan its scan
        paths = [r["path"] for r in registry.changed_files(files.scan_tree(spark, root), known).select("path").collect()]
    if paths == []:
        return records(files.scan_tree(spark, root, content=True).limit(0))
    parts = []
    for extension in files.EXTENSIONS:  # each reader opens its own files only
        own = None if paths is None else [p for p in paths if p.lower().endswith("." + extension)]
        if own != []:
            parts.append(records(files.scan_tree(spark, root, content=True, extension=extension, paths=own).where(F.col("format").isin(*(("docx", "doc_converted") if extension == "docx" else (extension,))))))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def finalize(records: DataFrame, *, date_overrides: DataFrame | None = None, title_overrides: DataFrame | None = None, ungrouped: DataFrame | None = None) -> DataFrame:
    """Overrides, then duplicates, then versions among what is left."""
    known = registry.mark_duplicates(registry.apply_overrides(records, date_overrides, title_overrides), ordinal="file_path")
    return registry.mark_versions(known, ungrouped, ordinal="file_path")


def elements(spark: SparkSession, root: str, records: DataFrame, markdown: DataFrame | None = None) -> DataFrame:
    """Elements of the indexable records, by format, and of markdown documents (sources.files.scan_markdown)."""
    wanted = registry.indexable(records).select("doc_id", "file_path", "format", F.coalesce("doc_title", F.lit("")).alias("doc_title"))
    content = lambda extension: files.scan_tree(spark, root, content=True, extension=extension).select("file_path", "content").join(wanted, "file_path")
    titles = wanted.select("doc_id", "doc_title")
    plain = content("txt").select("doc_id", decoded(F.col("content")).alias("text"))
    text = structure.text_elements(files.text_lines(plain).join(titles, "doc_id"), title="doc_title")
    word = structure.word_elements(files.read_word(content("docx")).join(titles, "doc_id"))
    grid = files.read_sheets(content("xlsx")).where("cells is not null")
    sheet = structure.sheet_elements(grid).withColumn("seq", (F.col("sheet_no") * 1_048_577 + F.col("seq")).cast("int")).drop("sheet_no")
    out = text.unionByName(word).unionByName(sheet)
    return out if markdown is None else out.unionByName(structure.markdown_elements(markdown))


def chunks(spark: SparkSession, root: str, records: DataFrame, markdown: DataFrame | None = None, *, limit: int = 400) -> DataFrame:
    docs = registry.indexable(records)
    if markdown is not None:
        docs = docs.unionByName(markdown.drop("text", "status"), allowMissingColumns=True)
    return chunking.build_chunks(elements(spark, root, records, markdown), docs, limit=limit)


class Retriever(Protocol):
    """What search() needs of an index: operators.bm25.Index, operators.dense.Index or a caller's own."""

    def retrieve(self, questions: DataFrame, *, k: int = 5, drilldown: bool = True) -> DataFrame:
        """qid, rank, score and the chunk's fields of the best k chunks of each question."""


def search(index: Retriever, questions: DataFrame, *, k: int = 5, drilldown: bool = True) -> DataFrame:
    """Hits with their citations, ready for triage and prompts."""
    hits = index.retrieve(questions, k=k, drilldown=drilldown)
    made = citation(*(F.col(c) for c in ("file_name", "doc_title", "format", "doc_version", "is_latest", "location", "citation_level")))
    return hits.withColumn("citation", made).withColumn("article_no", F.col("location.article_no"))


def listing(hits: DataFrame) -> DataFrame:
    """Hits as lines to be read."""
    return hits.select("qid", "rank", F.format_string("[%d] %.3f %s | %s", "rank", "score", "citation", F.substring(F.translate("text", "\n", " "), 1, 120)).alias("line"))


def level_histogram(chunks: DataFrame) -> DataFrame:
    counts = chunks.groupBy("citation_level").agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(counts.agg(F.sum("n").alias("t"))), F.lit(True)).select("citation_level", "n", (F.col("n") / F.col("t")).alias("share"))
