"""Effective dates as strings: YYYY-MM-DD or YYYY-MM, compared as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: a date followed within 40 characters by what was done to the law on it.
_DATED = "(\\d{4})年(\\d{1,2})月(\\d{1,2})日[^\\d，。]{0,40}?(第?[一二三四五六七八九十]*次?(?:修正|修订)|公布|通过|发布|施行|印发)"


def _dated(text: Column) -> Column:
    group = lambda i: F.regexp_extract_all(text, F.lit(_DATED), F.lit(i))
    rows = F.arrays_zip(group(1), group(2), group(3), group(4))
    two = lambda x: F.lpad(x, 2, "0")
    return F.transform(rows, lambda r: F.struct(F.concat(r["0"], F.lit("-"), two(r["1"]), F.lit("-"), two(r["2"])).alias("day"), F.contains(r["3"], F.lit("修")).alias("revised")))


def effective_date(lines: Column) -> Column:
    """Of an array of lines: the latest day of a revision, else the first day of a publication, else null."""
    days = F.flatten(F.transform(lines, _dated))
    revised = F.transform(F.filter(days, lambda d: d["revised"]), lambda d: d["day"])
    return F.coalesce(F.array_max(revised), F.get(days, F.lit(0))["day"])


def file_name_date(name: Column) -> Column:
    """The first eight digits if they start with 19 or 20, else year and month in Chinese, else null."""
    eight = F.regexp_extract(name, "(\\d{8})", 1)
    day = F.when(F.substring(eight, 1, 2).isin("19", "20"), F.concat_ws("-", F.substring(eight, 1, 4), F.substring(eight, 5, 2), F.substring(eight, 7, 2)))
    year = F.regexp_extract(name, "(\\d{4})年(\\d{1,2})月", 1)
    month = F.when(year != "", F.concat(year, F.lit("-"), F.lpad(F.regexp_extract(name, "(\\d{4})年(\\d{1,2})月", 2), 2, "0")))
    return F.coalesce(day, month)


def resolved_date(fmt: Column, own: Column, from_name: Column) -> Column:
    """Word files take the later of their own and their name's date; others their own, then their name's."""
    return F.when(fmt.isin("docx", "doc_converted"), F.greatest(own, from_name)).otherwise(F.coalesce(own, from_name))
