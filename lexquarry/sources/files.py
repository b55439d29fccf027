"""Corpus files: what the tree holds, and binary files as rows. Python reads only the zipped formats; bad files become a status."""

from __future__ import annotations

import io
import re
import zipfile
from datetime import datetime, timedelta
from functools import lru_cache
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexquarry.functions.text import clean, decoded


#: Formats of the corpus tree by the extension of their files.
EXTENSIONS = ("docx", "txt", "xlsx")


def relative(path: Column, root: str) -> Column:
    """A file's path below root, whatever scheme either is given with."""
    base = "/" + re.sub("^[A-Za-z0-9+.-]+:/*", "", root).strip("/") + "/"
    return F.substring(F.regexp_replace(path, "^[A-Za-z0-9+.-]+:/*", "/"), len(base) + 1, 1 << 20)


def located(files: DataFrame, root: str) -> DataFrame:
    """Files (path, modificationTime, length, content if there) as file_path below root, path, format, size, mtime, content; unknown formats are left out."""
    rel = relative(F.col("path"), root)
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    fmt = F.when(ext == "docx", F.when(rel.startswith("converted_docx"), "doc_converted").otherwise("docx")).when(ext.isin(*EXTENSIONS), ext)
    content = ["content"] if "content" in files.columns else []
    found = files.select(rel.alias("file_path"), "path", fmt.alias("format"), F.col("length").alias("size"), (F.unix_millis("modificationTime").cast("double") / 1000).alias("mtime"), *content)
    return found.where("format is not null")


def scan_tree(spark: SparkSession, root: str, *, content: bool = False, extension: str | None = None, paths: list[str] | None = None) -> DataFrame:
    """Files of the known formats below root, or those of `paths`: file_path, path, format, size, mtime, and content if asked for (else it isn't read).

    extension: files of others aren't even opened.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if extension:
        reader = reader.option("pathGlobFilter", "*." + "".join(f"[{c}{c.upper()}]" for c in extension))
    files = reader.load(root if paths is None else [re.sub(r"([\[\]{}*?\\])", r"\\\1", p) for p in paths])
    return located(files if content else files.drop("content"), root)


def scan_markdown(spark: SparkSession, *folders: str) -> DataFrame:
    """Markdown files of the given folders, as documents of their own: ids of `synthetic/<name>`, titles from the name.

    A file that is not UTF-8 has a status of ERROR and no text, so it gives no elements.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(list(folders))
    name = F.regexp_extract("path", "([^/]+)$", 1)
    stem = F.regexp_replace(name, r"\.md$", "")
    clear = F.is_valid_utf8(F.col("content").cast("string"))
    return files.select(
        F.substring(F.sha1(F.encode(F.concat(F.lit("synthetic/"), name), "UTF-8")), 1, 16).alias("doc_id"), name.alias("file_path"), F.lit("md").alias("format"),
        F.lit("synthmd0").alias("doc_version"), F.substring_index(stem, "_", 1).alias("doc_title"), F.when(clear, decoded(F.col("content"))).alias("text"), F.lit(1).alias("is_latest"),
        F.when(clear, "OK").otherwise("ERROR: not UTF-8").alias("status"),
    )


def text_lines(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Cleaned lines of text files below `正文：` (of all, if there is no such line), without headers and page furniture: key, line (from 1), text."""
    body = F.regexp_replace(F.col(text), r"(?msU)\A.*?^正文：[^\S\n]*$", "")
    lines = F.transform(F.split(body, "\n"), lambda x: clean(x))
    heads = ("标题：", "栏目：", "发布日期：", "来源：", "原文链接：")  # fixed values
    keep = lambda x: (x != "") & ~x.rlike("^(" + "|".join(heads) + ")") & (x != "无障碍浏览") & ~x.rlike("下载文字版|下载图片版")
    return docs.select(key, F.posexplode(F.filter(lines, keep)).alias("line", "text")).withColumn("line", F.col("line") + 1)


def text_header(docs: DataFrame, *, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Title, date, issuer, link and body of text files, from the first 1500 characters and the body; the columns `keep` are kept."""
    from lexquarry.functions.dates import effective_date
    from lexquarry.functions.text import strip

    top = F.substring(text, 1, 1500)
    named = lambda k: F.nullif(strip(F.regexp_extract(top, f"(?m)^{k}：(.+)$", 1)), F.lit(""))
    # fixed values: names of header lines
    df = docs.select(key, *keep, F.col(text).alias("raw"), named("标题").alias("title"), named("发布日期").alias("issued"), named("来源").alias("issuing_org"), named("原文链接").alias("source_url"))
    marked = F.regexp_count("raw", F.lit(r"(?mU)^正文：\s*$")) > 0
    after_link = F.when(F.col("source_url").isNotNull(), F.substring("raw", F.position(F.col("source_url"), F.col("raw")) + F.length("source_url"), F.length("raw"))).otherwise(F.col("raw"))
    body = F.when(marked, F.regexp_replace("raw", r"(?msU)\A.*?^正文：\s*$", "")).otherwise(after_link)
    df = df.withColumn("body", body)
    lines = F.transform(F.split("body", "\r\n|[\n\r]"), lambda x: strip(x))
    usable = F.filter(lines, lambda x: (x != "") & (F.length(x) <= 60) & (x != "无障碍浏览") & ~F.contains(x, F.lit("下载")))
    return df.select(
        key, *keep,
        F.coalesce("title", F.get(usable, F.lit(0))).alias("doc_title"),
        F.when(F.col("title").isNotNull(), "txt_header").when(F.size(usable) > 0, "body_first_line").otherwise("FAIL").alias("title_source"),
        F.coalesce(effective_date(F.split(F.substring("body", 1, 1200), "\r\n|[\n\r]")), F.col("issued")).alias("effective_date"),
        "issuing_org", "source_url", "body",
    )


def word_title(texts, *, limit: int = 60):
    """Title and its source from the cleaned, non-blank texts of a word file: the first, joined to the second where it breaks off."""
    suffixes = "法|决定|办法|条例|规定|通知|意见|公告|细则|规则|纲要|解释"  # fixed values
    first, second = F.coalesce(F.get(texts, F.lit(0)), F.lit("")), F.get(texts, F.lit(1))
    open_ = ~first.rlike("[。，,.]") & ((F.length(first) <= 10) | ((F.length(first) <= 30) & ~first.rlike(f"({suffixes})$")))
    goes_on = second.isNotNull() & (F.length(second) <= 40) & ~second.contains("。") & ~second.rlike("^[第（(]") & F.concat(first, second).rlike(f"({suffixes})$")
    title = F.when((first != "") & open_ & goes_on, F.concat(first, second)).otherwise(first)
    bad = (title == "") | (F.length(title) > limit) | title.endswith("。")
    return title, F.when(bad, "FAIL").otherwise("first_para")


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _word_text(node) -> str:
    return "".join(t.text or "" for t in node.iter(_W + "t"))


def _word_rows(table) -> list[list[str]]:
    """Cells of each row; a cell over several columns counts in each, one over several rows in each."""
    rows: list[list[str]] = []
    for tr in table.findall(_W + "tr"):
        cells: list[str] = []
        for tc in tr.findall(_W + "tc"):
            span = tc.find(f"{_W}tcPr/{_W}gridSpan")
            merged = tc.find(f"{_W}tcPr/{_W}vMerge")
            text = "\n".join(_word_text(p) for p in tc.findall(_W + "p"))
            if merged is not None and merged.get(_W + "val", "continue") == "continue" and rows and len(rows[-1]) > len(cells):
                text = rows[-1][len(cells)]
            cells += [text] * int(span.get(_W + "val") if span is not None else 1)
        rows.append(cells)
    return rows


def read_word(docs: DataFrame, *, key: str = "doc_id", content: str = "content", keep: tuple[str, ...] = ()) -> DataFrame:
    """Word files as lines: key, kind (p, or tr for a row of a table), ord, table, place (paragraphs before the table), row, cells, status, and the columns `keep`."""

    def read(it):
        for pdf in it:
            out = []
            for k, data, *rest in zip(pdf[key], pdf[content], *(pdf[c] for c in keep), strict=True):
                have = len(out)
                try:
                    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(_W + "body")
                    n = tables = 0
                    for child in body:
                        if child.tag == _W + "p":
                            out.append((k, "p", n, None, None, None, [_word_text(child)], "OK"))
                            n += 1
                        elif child.tag == _W + "tbl":
                            tables += 1
                            out += [(k, "tr", n, tables, n, r, cells, "OK") for r, cells in enumerate(_word_rows(child))]
                            n += 1
                    if not n:
                        out.append((k, None, 0, None, None, None, None, "OK"))
                except Exception as e:  # one bad file must not stop the others
                    out[have:] = [(k, None, 0, None, None, None, None, f"ERROR: {type(e).__name__}: {e}"[:200])]
                out[have:] = [(*r, *rest) for r in out[have:]]
            yield pd.DataFrame(out, columns=[key, "kind", "ord", "table", "place", "row", "cells", "status", *keep])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    more = "".join(f", `{c}` {kinds[c]}" for c in keep)
    return docs.select(key, content, *keep).mapInPandas(read, f"`{key}` {kinds[key]}, kind string, ord int, `table` int, place int, `row` int, cells array<string>, status string{more}")


_NUMBER = re.compile(r"^-?[\d,，.%\s]+$")
#: Rows that a reader hands on at a time.
_ROWS = 4_096


def _is_date_format(code: str) -> bool:
    return bool(re.search(r"[dmyhs]", re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", code.lower())))


@lru_cache(maxsize=16)
def _small_part(read, xml: bytes):
    return read(xml)


def _part(read, xml: bytes):
    """What a part of a workbook says. Small parts are much the same in many files, so the last ones are remembered."""
    return _small_part(read, xml) if len(xml) <= 1 << 14 else read(xml)


def _strings(xml: bytes) -> list[str]:
    return [_shared_text(x) for x in ElementTree.fromstring(xml)]


def _date_styles(xml: bytes) -> list[bool]:
    """Of each cell style, whether it shows dates."""
    styles, dates = ElementTree.fromstring(xml), []
    custom = {int(x.get("numFmtId")): _is_date_format(x.get("formatCode", "")) for x in styles.iter(_S + "numFmt")}
    for xf in styles.find(_S + "cellXfs") if styles.find(_S + "cellXfs") is not None else []:
        i = int(xf.get("numFmtId", 0))
        dates.append(custom.get(i, 14 <= i <= 22 or 45 <= i <= 47))
    return dates


def _targets(xml: bytes) -> dict[str, str]:
    return {x.get("Id"): x.get("Target") for x in ElementTree.fromstring(xml)}


def _sheets(xml: bytes) -> list[tuple[str, str]]:
    return [(x.get("name"), x.get(_R + "id")) for x in ElementTree.fromstring(xml).iter(_S + "sheet")]


def _sheet_rows(data: bytes):
    """(sheet number, name, row, values, kinds) of all rows with merged ranges filled; kinds are _ (empty), N (number) or T."""
    z = zipfile.ZipFile(io.BytesIO(data))
    names = set(z.namelist())
    shared = _part(_strings, z.read("xl/sharedStrings.xml")) if "xl/sharedStrings.xml" in names else []
    dates = _part(_date_styles, z.read("xl/styles.xml")) if "xl/styles.xml" in names else []
    rels = _part(_targets, z.read("xl/_rels/workbook.xml.rels"))
    for number, (name, rel) in enumerate(_part(_sheets, z.read("xl/workbook.xml"))):
        target = rels[rel]
        tree = ElementTree.fromstring(z.read(target.lstrip("/") if target.startswith("/") else "xl/" + target))
        grid: dict[tuple[int, int], object] = {}
        at_row = 0
        for row in tree.iter(_S + "row"):
            at_row = int(row.get("r", at_row + 1))
            at_col = 0
            for c in row.findall(_S + "c"):
                at_col = _column(c.get("r")) if c.get("r") else at_col + 1
                grid[at_row, at_col] = _value(c, shared, dates)
        for merged in tree.iter(_S + "mergeCell"):
            a, _, b = merged.get("ref").partition(":")
            (r1, c1), (r2, c2) = _cell(a), _cell(b or a)
            for r in range(r1, r2 + 1):
                for k in range(c1, c2 + 1):
                    grid[r, k] = grid.get((r1, c1))
        if not grid:
            continue
        rows, cols = max(r for r, _ in grid), max(c for _, c in grid)
        for r in range(1, rows + 1):
            values = [grid.get((r, c)) for c in range(1, cols + 1)]
            shown = ["" if v is None else str(v).strip() for v in values]
            kinds = ["_" if not s else "N" if isinstance(v, (int, float)) or _NUMBER.match(s) else "T" for v, s in zip(values, shown, strict=True)]
            yield number, name, r, shown, kinds


def _shared_text(x) -> str:
    return "".join(t.text or "" for t in x.iter(_S + "t"))


def _column(ref: str) -> int:
    n = 0
    for ch in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(ch) - 64
    return n


def _cell(ref: str) -> tuple[int, int]:
    return int(re.search(r"\d+", ref)[0]), _column(ref)


def _value(c, shared: list[str], dates: list[bool]):
    kind, v = c.get("t", "n"), c.find(_S + "v")
    if kind == "inlineStr":
        return _shared_text(c)
    if v is None or v.text is None:
        return None
    if kind == "s":
        return shared[int(v.text)]
    if kind in ("str", "e", "d"):
        return v.text
    if kind == "b":
        return v.text == "1"
    number = float(v.text)
    style = int(c.get("s", 0))
    if style < len(dates) and dates[style]:
        return datetime(1899, 12, 30) + timedelta(days=number)
    return int(v.text) if re.fullmatch(r"-?\d+", v.text) else number


def read_sheets(docs: DataFrame, *, key: str = "doc_id", content: str = "content", keep: tuple[str, ...] = ()) -> DataFrame:
    """Spreadsheets as rows: key, sheet_no, sheet_name, row, cells, kinds, status, and the columns `keep`."""
    fields = [("sheet_no", pa.int32()), ("sheet_name", pa.string()), ("row", pa.int32()), ("cells", pa.list_(pa.string())), ("kinds", pa.list_(pa.string())), ("status", pa.string())]

    def read(it):
        for batch in it:
            at, out = [], []

            def rows():
                whose = pa.array(at, pa.int32())
                found = [pa.array(c, kind) for c, (_, kind) in zip(zip(*out, strict=True), fields, strict=True)]
                return pa.RecordBatch.from_arrays([batch.column(0).take(whose), *found, *(c.take(whose) for c in batch.columns[2:])], [key, *(n for n, _ in fields), *keep])

            for i, data in enumerate(batch.column(1)):
                have = len(out)
                try:
                    for r in _sheet_rows(data.as_py()):
                        out.append((*r, "OK"))
                    if len(out) == have:
                        out.append((None, None, None, None, None, "OK"))
                except Exception as e:  # one bad file must not stop the others
                    out[have:] = [(None, None, None, None, None, f"ERROR: {type(e).__name__}: {e}"[:200])]
                at += [i] * (len(out) - have)
                if len(out) >= _ROWS:
                    yield rows()
                    at, out = [], []
            if out:
                yield rows()

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    more = "".join(f", `{c}` {kinds[c]}" for c in keep)
    return docs.select(key, content, *keep).mapInArrow(read, f"`{key}` {kinds[key]}, sheet_no int, sheet_name string, `row` int, cells array<string>, kinds array<string>, status string{more}")


def sheet_body(rows: DataFrame, *, key: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """The searchable text of spreadsheets: cells joined by |, rows by a newline; empty for a file without rows. Also the worst status and the columns `keep`."""
    line = F.when(F.col("cells").isNotNull(), F.struct("sheet_no", "row", F.array_join(F.filter("cells", lambda c: c != ""), "|").alias("line")))
    status = [F.max("status").alias("status")] if "status" in rows.columns else []
    grouped = rows.groupBy(key).agg(F.array_sort(F.collect_list(line)).alias("all"), *status, *(F.first(c).alias(c) for c in keep))
    return grouped.select(key, *keep, F.array_join(F.transform("all", lambda x: x["line"]), "\n").alias("body"), *(["status"] if status else []))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is such a file or folder, in whatever store Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def remove(spark: SparkSession, path: str) -> None:
    """Removes a file or folder, if there is one."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def json_map(spark: SparkSession, path: str, *, value: str = "string") -> DataFrame:
    """A JSON object file as (key, value) rows; a missing file has none."""
    if not exists(spark, path):
        return spark.createDataFrame([], f"key string, value {value}")
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", f"map<string, {value}>")).alias("key", "value"))


def registry_log(lines: DataFrame, *, key: str = "doc_id", ordinal: str = "line") -> DataFrame:
    """Of an append-only log: for each key the last record, at the place of the first."""
    fields = [c for c in lines.columns if c not in (key, ordinal)]
    last = lines.groupBy(key).agg(F.max_by(F.struct(*fields), ordinal).alias("_last"), F.min(ordinal).alias(ordinal))
    return last.select(key, *(F.col(f"_last.{c}").alias(c) for c in fields), ordinal)


def read_testset(spark: SparkSession, path: str) -> DataFrame:
    from lexquarry.types import QUESTION

    return spark.read.schema(QUESTION).json(path).where("qid is not null")
