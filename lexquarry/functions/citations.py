"""Citation grade and citation text of a chunk: columns over file_name, doc_title, format, doc_version, is_latest and location."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _has(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def citation_level(file_name: Column, doc_title: Column, fmt: Column, loc: Column) -> Column:
    """A: found by the fields its format needs; B: with some missing; C: not to be found."""
    path = F.coalesce(F.size(loc["heading_path"]), F.lit(0)) > 0
    columns = F.coalesce(F.size(loc["column_names"]), F.lit(0)) > 0
    titled, sure = _has(doc_title), F.coalesce(loc["column_names_confidence"], F.lit("ok")) != "uncertain"
    sheet = F.when(_has(file_name) & _has(loc["sheet_name"]) & loc["table_index"].isNotNull() & _has(loc["row_range"]) & columns, F.when(sure, "A").otherwise("B")).when(_has(loc["sheet_name"]), "B").otherwise("C")
    placed = loc["paragraph_seq"].isNotNull()
    text = (
        F.when(_has(loc["article_no"]) | (path & placed), F.when(titled, "A").otherwise("B"))
        .when(placed & _has(loc["anchor_text"]) & titled, "A")
        .when(placed & (_has(loc["anchor_text"]) | titled), "B")
        .otherwise("C")
    )
    return F.when(fmt == "xlsx", sheet).otherwise(text)


def citation(file_name: Column, doc_title: Column, fmt: Column, version: Column, latest: Column, loc: Column, level: Column) -> Column:
    """The place in words, the version, and what is doubtful about it."""
    shown = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    path = F.coalesce(loc["heading_path"], F.array().cast("array<string>"))
    head = F.when(_has(doc_title), F.concat(F.lit("《"), doc_title, F.lit("》"))).otherwise(file_name)
    seq = F.concat(F.lit("段"), loc["paragraph_seq"].cast("string"))
    below = F.slice(path, 2, 1000)
    article = F.array(F.when(F.size(below) > 0, F.array_join(below, " > ")), loc["article_no"])
    sheet = F.array(F.concat(F.lit("sheet:"), loc["sheet_name"], F.lit(" 表"), shown(loc["table_index"]), F.lit(" 行"), shown(loc["row_range"])))
    anchor = F.when(_has(loc["anchor_text"]), F.concat(F.lit("“"), loc["anchor_text"], F.lit("…”")))
    where = (
        F.when(_has(loc["article_no"]), article)
        .when((fmt == "xlsx") & _has(loc["sheet_name"]), sheet)
        .when(F.size(path) > 0, F.array(F.array_join(path, " > "), seq))
        .when(loc["paragraph_seq"].isNotNull(), F.array(seq, anchor))
        .otherwise(F.array().cast("array<string>"))
    )
    parts = F.array_join(F.array_compact(F.concat(F.array(head), where)), " · ")
    note = lambda when, text: F.when(when, text).otherwise("")
    return F.concat(
        parts, F.lit(" [v"), version, F.lit("]"),
        note(F.coalesce(latest, F.lit(0)) == 0, "（历史版本）"),
        note(level == "B", "（引用定位不完整）"),
        note(F.coalesce(loc["column_names_confidence"], F.lit("ok")) == "uncertain", "（列名可能不准确,请核对原表）"),
    )
