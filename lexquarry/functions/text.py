"""Text functions as columns: cleaning, legal structure, numerals, tokens, answer keys. No Python on executors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the document rules.
NUMERALS = "一二三四五六七八九十零百千"
INVISIBLE = "[​‌‍﻿　]"
MARKS = "A-Za-z0-9〔〕\\[\\]第条章节%．.-"
FULL_WIDTH = "０１２３４５６７８９％（）：，；．"
HALF_WIDTH = "0123456789%():,;."
REFUSAL = "知识库中未找到足够依据,无法回答。"

_SPACE = "(?U)\\s+"


def strip(text: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(text, "(?U)^[\\s\\x1c-\\x1f]+|[\\s\\x1c-\\x1f]+$", "")


def clean(text: Column) -> Column:
    """Without invisible characters (ideographic spaces among them), stripped."""
    return strip(F.regexp_replace(text, INVISIBLE, ""))


def collapse(text: Column) -> Column:
    return F.regexp_replace(text, _SPACE, " ")


def squeeze(text: Column) -> Column:
    """Without any white space."""
    return F.regexp_replace(text, _SPACE, "")


def fingerprint(text: Column) -> Column:
    """Sixteen hex digits of the text without white space; null for a blank text."""
    return F.when(squeeze(text) != "", F.substring(F.sha1(F.encode(squeeze(text), "UTF-8")), 1, 16))


def norm_title(title: Column) -> Column:
    """A title to group versions by: no book marks, no invisibles, no closing bracket with a year of revision; null under six characters."""
    bare = F.regexp_replace(F.regexp_replace(title, "[《》]", ""), "(?U)[​‌‍﻿　\\s]", "")
    bare = F.regexp_replace(bare, "[(（]\\d{4}.*?[修订正].*?[)）]$", "")
    return F.when(F.length(bare) >= 6, bare)


def unit_mark(text: Column, unit: str) -> Column:
    """The leading mark of a part, chapter, section or article (编, 章, 节, 条); null if the text doesn't start with one."""
    return F.nullif(F.regexp_extract(text, f"^(第[{NUMERALS}]+{unit})", 1), F.lit(""))


def is_unit(text: Column, unit: str) -> Column:
    return text.rlike(f"^第[{NUMERALS}]+{unit}")


def numeral_value(numeral: Column, *, thousands: bool = False) -> Column:
    """The value of a Chinese numeral. By default 千 carries no value, as the fixed rule has it; thousands=True reads it."""
    digits = F.array(*(F.lit(c) for c in NUMERALS[:9]))
    text = F.when(numeral.startswith("十"), F.concat(F.lit("一"), numeral)).otherwise(numeral)
    units = {"十": 10, "百": 100} | ({"千": 1000} if thousands else {})

    def step(state: Column, c: Column) -> Column:
        at = F.array_position(digits, c)
        factor = reduce(lambda e, u: F.when(c == u, units[u]).otherwise(e), units, F.lit(0))
        ones = F.when(state["num"] == 0, 1).otherwise(state["num"])
        total = F.when(factor > 0, state["total"] + ones * factor).otherwise(state["total"])
        num = F.when(factor > 0, 0).when(at > 0, at).when(c == "零", 0).otherwise(state["num"])
        return F.struct(total.cast("long").alias("total"), num.cast("long").alias("num"))

    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("num"))
    return F.aggregate(F.split(text, ""), start, step, lambda s: s["total"] + s["num"])


def row_text(headers: Column, cells: Column, *, bare: bool = True) -> Column:
    """`header=cell` of the cells that aren't empty, joined by ` | `; without a header the bare cell (or `=cell`)."""
    cell = lambda h, v: F.when(F.coalesce(v, F.lit("")) != "", F.when((h == "") & F.lit(bare), v).otherwise(F.concat(h, F.lit("="), v)))
    both = F.zip_with(headers, F.slice(cells, 1, F.size(headers)), lambda h, v: cell(F.coalesce(h, F.lit("")), v))
    return F.array_join(F.array_compact(both), " | ")


def tokens(text: Column) -> Column:
    """Runs of marks and letters first, then pairs of neighbouring Han characters (neighbours once all else is left out)."""
    han = F.regexp_replace(text, "[^一-鿿]+", "")
    pairs = lambda h: F.when(F.length(h) > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.length(h) - 1, F.lit(1))), lambda i: F.substring(h, i, F.lit(2)))).otherwise(F.array())
    # as an element, so that it is computed once
    return F.concat(F.regexp_extract_all(squeeze(text), F.lit(f"([{MARKS}]+)"), F.lit(1)), F.get(F.transform(F.array(han), pairs), F.lit(0)))


def half_width(text: Column) -> Column:
    """Full-width digits and punctuation to ASCII, without white space."""
    return squeeze(F.translate(text, FULL_WIDTH, HALF_WIDTH))


def number_in(key: Column, text: Column) -> Column:
    """Whether text holds key, or a decimal within a thousandth of it, if key starts with a decimal."""
    value = F.regexp_extract(key, "^\\d+\\.\\d+", 0)
    others = F.regexp_extract_all(text, F.lit("(\\d+\\.\\d+)"), F.lit(1))
    near = F.exists(others, lambda t: F.abs(t.cast("double") - value.try_cast("double")) / F.greatest(F.abs(value.try_cast("double")), F.lit(1e-12)) < 1e-3)
    return text.contains(key) | ((value != "") & near)


# fixed value: what counts as a fact of an answer
_KEYS = "(\\d{4}年\\d{1,2}月\\d{1,2}日|[〔\\[]\\d{4}[〕\\]]\\S{0,6}号|\\d+(?:\\.\\d+)?(?:%|年|日|个月|万元|元|倍)?|[一二三四五六七八九十百千]+[万元年日个月])"


def answer_keys(golden: Column) -> Column:
    """The first four facts of an answer: dates, document numbers, amounts, of two characters or more."""
    return F.slice(F.filter(F.regexp_extract_all(half_width(golden), F.lit(_KEYS), F.lit(1)), lambda k: F.length(k) >= 2), 1, 4)


def holds_answer(golden: Column, text: Column) -> Column:
    """Whether text states the keys of the golden answer; without keys, two of its first, middle and last eight characters."""
    golden_, text_ = half_width(golden), half_width(text)
    keys = answer_keys(golden)
    n = F.length(golden_)
    parts = F.array(F.substring(golden_, 1, 8), F.substring(golden_, F.floor(n / 2).cast("int") + 1, F.lit(8)), F.when(n > 8, F.right(golden_, F.lit(8))).otherwise(golden_))
    some = F.size(F.filter(parts, lambda p: (p != "") & text_.contains(p))) >= 2
    each = F.forall(keys, lambda k: F.when(k.rlike("^\\d"), number_in(k, text_)).otherwise(text_.contains(k)))
    return F.when(F.size(keys) == 0, some).otherwise(each)


def expected_files(path: Column) -> Column:
    """File names of a path list joined by plus signs; none for null or empty."""
    names = F.transform(F.split(path, "\\+"), lambda p: F.element_at(F.split(strip(p), "/"), -1))
    return F.when(F.coalesce(path, F.lit("")) != "", names).otherwise(F.array().cast("array<string>"))


def expected_article(locator: Column) -> Column:
    return F.nullif(F.regexp_extract(locator, f"第[{NUMERALS}]+条", 0), F.lit(""))


def refuses(answer: Column) -> Column:
    """Whether an answer's start is the refusal sentence, commas of either width."""
    head = F.translate(F.substring(F.replace(answer, F.lit(" "), F.lit("")), 1, 40), "，", ",")
    return head.contains(REFUSAL.rstrip("。"))


def decoded(content: Column) -> Column:
    """UTF-8 bytes as text: each malformed sequence becomes one U+FFFD, and every line end a line feed."""
    return F.regexp_replace(F.make_valid_utf8(content.cast("string")), "\r\n?", "\n")


def slashes(path: Column) -> Column:
    return F.translate(path, "\\", "/")
