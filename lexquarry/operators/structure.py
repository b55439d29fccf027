"""Structure of documents: law lines, markdown and sheets as elements, by windows over a document's lines.

Elements: key, seq (order), kind (heading, article, paragraph, table_row), text, location.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexquarry.functions.text import collapse, is_unit, row_text, strip, unit_mark
from lexquarry.types import LOCATION

FIELDS = ("heading_path", "article_no", "paragraph_seq", "anchor_text", "sheet_name", "table_index", "row_range", "column_names", "column_names_confidence")


def location(**given: Column) -> Column:
    default = {"column_names_confidence": F.lit("ok")}
    return F.struct(*(given.get(f, default.get(f, F.lit(None))).alias(f) for f in FIELDS)).cast(LOCATION)


def law_structured(lines: DataFrame, *, key: str = "doc_id", least: int = 3) -> DataFrame:
    """Adds structured: whether a document has so many article lines."""
    return lines.withColumn("structured", F.count_if(is_unit(F.col("text"), "条")).over(Window.partitionBy(key)) >= least)


def without_contents(lines: DataFrame, *, key: str = "doc_id", line: str = "line") -> DataFrame:
    """Law lines without their table of contents: of the chapters before the first article only the last one counts."""
    doc = Window.partitionBy(key)
    text = F.col("text")
    first = F.min(F.when(is_unit(text, "条"), F.col(line))).over(doc)
    lines = lines.withColumn("_first", first)
    listed = F.when(is_unit(text, "章") & (F.col(line) < F.col("_first")), F.col(line))
    lines = lines.withColumn("_last", F.max(listed).over(doc)).withColumn("_lo", F.min(listed).over(doc))
    dropped = F.when(listed.isNotNull() & (F.col(line) < F.col("_last")), F.col(line))
    lines = lines.withColumn("_hi", F.max(dropped).over(doc))
    before = F.col(line) < F.col("_first")
    # the contents reach from the first to the last dropped chapter; a single chapter is no contents
    inner = (is_unit(text, "节") | is_unit(text, "编")) & F.col(line).between(F.col("_lo"), F.col("_hi"))
    word = F.regexp_replace(text, "(?U)\\s", "") == "目录"
    skip = F.coalesce(before & (dropped.isNotNull() | inner | word), F.lit(False))
    return lines.where(~skip).drop("_first", "_last", "_lo", "_hi")


def law_elements(lines: DataFrame, *, key: str = "doc_id", line: str = "line", title: str | None = None) -> DataFrame:
    """Elements of law lines (contents left out): each under its chapter and section."""
    by = Window.partitionBy(key).orderBy(line)
    text = F.col("text")
    df = without_contents(lines, key=key, line=line).withColumn("seq", F.row_number().over(by)).withColumn("_t", collapse(text))
    chapter, section = is_unit(text, "章"), is_unit(text, "节")
    df = df.withColumn("_ch", F.last(F.when(chapter, F.struct("seq", "_t")), ignorenulls=True).over(by)).withColumn("_se", F.last(F.when(section, F.struct("seq", "_t")), ignorenulls=True).over(by))
    under = F.when(F.coalesce(F.col("_se.seq") > F.col("_ch.seq"), F.col("_se").isNotNull()), F.col("_se._t"))
    head = F.nullif(F.col(title), F.lit("")) if title else F.lit(None).cast("string")
    path = F.array_compact(F.array(head, F.col("_ch._t"), under))
    kind = F.when(chapter | section, "heading").when(is_unit(text, "条"), "article").otherwise("paragraph")
    anchor = F.when(kind == "paragraph", F.substring("_t", 1, 20))
    loc = location(heading_path=path, article_no=F.when(kind == "article", unit_mark(text, "条")), paragraph_seq=F.col("seq"), anchor_text=anchor)
    return df.select(key, "seq", kind.alias("kind"), F.col("_t").alias("text"), loc.alias("location"))


def plain_elements(lines: DataFrame, *, key: str = "doc_id", line: str = "line") -> DataFrame:
    seq = F.row_number().over(Window.partitionBy(key).orderBy(line))
    return lines.withColumn("seq", seq).select(key, "seq", F.lit("paragraph").alias("kind"), "text", location(paragraph_seq=F.col("seq"), anchor_text=F.substring("text", 1, 20)).alias("location"))


def text_elements(lines: DataFrame, *, key: str = "doc_id", line: str = "line", title: str | None = None) -> DataFrame:
    """Law elements of documents that read like laws, plain paragraphs of the others."""
    marked = law_structured(lines, key=key)
    return law_elements(marked.where("structured"), key=key, line=line, title=title).unionByName(plain_elements(marked.where("not structured"), key=key, line=line))


def word_elements(parts: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """Elements of word lines (sources.files.read_word): paragraphs, then the rows of all tables; a table's first row names its columns."""
    from lexquarry.functions.text import clean

    lines = parts.where("kind = 'p'").select(key, F.col("ord").alias("line"), clean(F.col("cells")[0]).alias("text")).where("text <> ''")
    texts = text_elements(lines, key=key)
    rows = parts.where("kind = 'tr'").withColumn("cells", F.transform("cells", lambda c: clean(c)))
    head = F.first("cells").over(Window.partitionBy(key, "table").orderBy("row"))
    # a table stands after the paragraphs that precede it, counted without blank ones
    before = lines.select(key, "line").groupBy(key).agg(F.array_sort(F.collect_list("line")).alias("lines"))
    rows = rows.withColumn("head", head).where("row > 0").join(before, key, "left")
    seq = F.coalesce(F.size(F.filter("lines", lambda x: x < F.col("place"))), F.lit(0))
    rows = rows.withColumn("text", row_text(F.col("head"), F.col("cells"))).where("text <> ''")
    order = F.col("table") * 1_000_000 + F.col("row") + 1_000_000_000
    loc = location(table_index=F.lit(1), row_range=F.concat(F.lit("r"), F.col("row").cast("string")), column_names=F.col("head"), paragraph_seq=seq)
    return texts.unionByName(rows.select(key, order.cast("int").alias("seq"), F.lit("table_row").alias("kind"), "text", loc.alias("location")))


def _followed(batches):
    """For mapInArrow over the lines of documents, each document's together and in order: adds what runs along with them.

    seq; h1 to h4, the heading that holds of each level; head, nth and table_no: of a line of a table its run's first row,
    the rows of the run so far, and the tables of the document so far. Held from batch to batch is the last line's.
    """
    last, held = None, {"seq": 0, "nth": 0, "table_no": 0, "open": False, "head": None, "h": [None] * 4}
    for batch in batches:
        if not batch.num_rows:
            continue
        column = lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: E731, B023
        of = lambda name: column(name).to_numpy(zero_copy_only=False)  # noqa: E731, B023
        doc, level, table, row, at = of("_doc"), of("level"), of("_is_table"), of("_is_row"), np.arange(batch.num_rows)
        latest = lambda where: np.maximum.accumulate(np.where(where, at, -1))  # noqa: E731, B023
        first = latest(doc != np.append(doc[0] - 1 if last is None or last != doc[0] else last, doc[:-1]))  # -1: goes on from the batch before
        goes_on = first < 0

        def since(flags: np.ndarray, start: np.ndarray, had: int, more: np.ndarray) -> np.ndarray:
            """How many of the lines from start on (of the batch, and so many before it) have the flag."""
            sums = np.append(0, np.cumsum(flags))
            return sums[1:] - sums[np.maximum(start, 0)] + np.where(more, had, 0)

        def taken(values: pa.Array, before, places: np.ndarray, start: np.ndarray, more: np.ndarray) -> pa.Array:
            """The values at places; before the batch the one held, before their start none."""
            whose = np.where(places >= np.maximum(start, 0), places + 1, np.where(more & (places < 0), 0, -1))
            return pa.concat_arrays([pa.array([before], values.type), values]).take(pa.array(whose, mask=whose < 0))

        seq = since(np.ones(len(at), bool), first, held["seq"], goes_on)
        # a heading holds until the next of its level or above
        ups = [latest((level > 0) & (level <= n)) for n in range(1, 5)]
        heads = [np.where((up >= 0) & (level[np.maximum(up, 0)] != n), -2, up) for n, up in enumerate(ups, 1)]
        paths = [taken(column("heading"), held["h"][n], heads[n], first, goes_on & (heads[n] == -1)) for n in range(4)]
        start = np.maximum(first, latest(~table))
        same = (start < 0) & held["open"]
        nth = since(row, start, held["nth"], same)
        tops = row & (nth == 1)
        head = taken(column("raw"), held["head"], latest(tops), start, same)
        table_no = since(tops, first, held["table_no"], goes_on)
        last, held = doc[-1], {"seq": int(seq[-1]), "nth": int(nth[-1]), "table_no": int(table_no[-1]), "open": bool(table[-1]), "head": head[-1].as_py(), "h": [h[-1].as_py() for h in paths]}
        more = [pa.array(x.astype(np.int32)) for x in (seq, nth, table_no)]
        yield pa.RecordBatch.from_arrays([*batch.columns, *more, head, *paths], [*batch.schema.names, "seq", "_nth", "_table", "_head_raw", "_h1", "_h2", "_h3", "_h4"])


def markdown_elements(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Elements of markdown: headings of four levels, pipe tables, articles and paragraphs; front matter names sheet and confidence.

    A document is a row, whose lines stay together when they are exploded, so they are followed where they are: nothing is shuffled or sorted.
    """
    lines = F.split(text, "\n")
    end = F.array_position(F.slice(F.col("_lines"), 2, 1 << 30), "---")
    fenced = (F.trim(F.get("_lines", F.lit(0))) == "---") & (end > 0)
    df = docs.select(key, lines.alias("_lines"), F.monotonically_increasing_id().alias("_doc")).withColumn("_end", F.when(fenced, end.cast("int")).otherwise(-1))
    front = F.when(F.col("_end") > 0, F.slice("_lines", 2, F.greatest(F.col("_end") - 1, F.lit(0))))
    entry = lambda name: strip(F.regexp_replace(F.try_element_at(F.filter(front, lambda x: strip(F.substring_index(x, ":", 1)) == name), F.lit(-1)), "^[^:]*:", ""))
    df = df.select(key, "_doc", entry("sheet_name").alias("_sheet"), entry("column_names_confidence").alias("_conf"), F.explode(F.slice("_lines", F.greatest(F.col("_end") + 2, F.lit(1)), 1 << 30)).alias("raw"))
    df = df.withColumn("raw", F.regexp_replace("raw", "(?U)\\s+$", "")).where(strip(F.col("raw")) != "")
    raw, table = F.col("raw"), F.col("_is_table")
    level = F.length(F.regexp_extract(raw, "^(#{1,4})\\s", 1))
    cells = lambda line: F.transform(F.split(F.regexp_replace(line, "^\\|+|\\|+$", ""), "\\|"), lambda c: strip(c))
    piped = F.startswith(raw, F.lit("|"))
    rule = piped & F.forall(cells(raw), lambda c: c.rlike("^-{3,}$"))
    df = df.select(key, "_doc", "_sheet", "_conf", "raw", level.alias("level"), F.when(level > 0, strip(F.regexp_extract(raw, "^#{1,4}\\s+(.*)", 1))).alias("heading"), piped.alias("_is_table"), (piped & ~rule).alias("_is_row"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    df = df.mapInArrow(_followed, f"{kinds}, seq int, _nth int, _table int, _head_raw string, _h1 string, _h2 string, _h3 string, _h4 string")
    df = df.where(~table | (F.col("_is_row") & (F.col("_nth") > 1))).withColumn("_head", F.when(table, cells(F.col("_head_raw"))))
    level = F.col("level")
    path = F.array_compact(F.array("_h1", "_h2", "_h3", "_h4"))
    body = F.regexp_replace(strip(raw), "^[-*>]\\s+", "")
    article = unit_mark(body, "条")
    kind = F.when(level > 0, "heading").when(table, "table_row").when(article.isNotNull(), "article").otherwise("paragraph")
    shown = F.when(level > 0, F.col("heading")).when(table, row_text(F.col("_head"), cells(raw), bare=False)).otherwise(body)
    of_table = lambda c: F.when(table, c)
    loc = location(
        heading_path=path, article_no=F.when(kind == "article", article), paragraph_seq=F.col("seq"), anchor_text=F.when((level == 0) & ~table, F.substring(body, 1, 20)),
        sheet_name=of_table(F.col("_sheet")), table_index=of_table(F.col("_table")), row_range=of_table(F.concat(F.lit("r"), F.col("seq").cast("string"))),
        column_names=of_table(F.col("_head")), column_names_confidence=F.when(table, F.coalesce("_conf", F.lit("ok"))).otherwise("ok"),
    )
    return df.select(key, "seq", kind.alias("kind"), shown.alias("text"), loc.alias("location"))


def sheet_layout(rows: DataFrame, *, key: tuple[str, ...] = ("doc_id", "sheet_no")) -> DataFrame:
    """Adds to sheet rows (cells, kinds): cells and kinds without empty columns, sig, data_sig, data_start, headers, confidence."""
    by = Window.partitionBy(*key)
    used = rows.select(*key, F.posexplode("kinds").alias("c", "k")).where("k <> '_'").groupBy(*key).agg(F.array_sort(F.collect_set("c")).alias("keep"))
    df = rows.join(used, list(key))
    pick = lambda c: F.transform("keep", lambda i: F.get(c, i))
    df = df.withColumn("cells", pick(F.col("cells"))).withColumn("kinds", pick(F.col("kinds"))).drop("keep").withColumn("sig", F.array_join("kinds", ""))
    full = F.col("sig").rlike("[^_]")
    counts = df.where(full).groupBy(*key, "sig").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    mode = counts.groupBy(*key).agg(F.min(F.struct(-F.col("n"), "first", "sig")).alias("m")).select(*key, F.col("m.sig").alias("data_sig"), F.col("m.first").alias("data_start"))
    df = df.join(mode, list(key))
    values = F.filter("cells", lambda c: c != "")
    numbers = F.size(F.filter("kinds", lambda k: k == "N"))
    head = (F.col("row") < F.col("data_start")) & full & (numbers <= 0.3 * F.size(values)) & (F.size(F.array_distinct(values)) > 2)
    heads = F.transform(F.array_sort(F.collect_list(F.when(head, F.struct("row", "cells"))).over(by)), lambda x: x["cells"])
    df = df.withColumn("_heads", heads)
    column = lambda i: F.array_join(F.array_distinct(F.filter(F.transform("_heads", lambda h: collapse(F.get(h, i))), lambda s: s != "")), ".")
    headers = F.transform(F.sequence(F.lit(0), F.size("cells") - 1), column)
    df = df.withColumn("headers", headers)
    sure = F.size("_heads").between(1, 3) & (F.size(F.filter("headers", lambda h: h == "")) < 0.3 * F.size("headers"))
    return df.withColumn("header_rows", F.size("_heads")).withColumn("confidence", F.when(sure, "ok").otherwise("uncertain")).drop("_heads")


def sheet_elements(rows: DataFrame, *, key: tuple[str, ...] = ("doc_id", "sheet_no")) -> DataFrame:
    """Elements of laid-out sheet rows: table rows and footnotes, with sub-tables counted at a second blank row in a run."""
    df = sheet_layout(rows, key=key).where("row >= data_start")
    by = Window.partitionBy(*key).orderBy("row")
    blank = ~F.col("sig").rlike("[^_]")
    df = df.withColumn("_blank", blank).withColumn("_run", F.col("row") - F.row_number().over(Window.partitionBy(*key, "_blank").orderBy("row")))
    df = df.withColumn("_streak", F.when(F.col("_blank"), F.row_number().over(Window.partitionBy(*key, "_blank", "_run").orderBy("row"))).otherwise(0))
    df = df.withColumn("table_index", F.sum((F.col("_streak") == 2).cast("int")).over(by) + 1)
    values = F.filter("cells", lambda c: c != "")
    small = F.filter("cells", lambda c: c.rlike("^\\d{1,3}$"))
    start = F.get(small, F.lit(0)).cast("int")
    counted = (F.size(small) >= 3) & (F.size(small) >= F.size(values) - 1) & (F.transform(small, lambda x: x.cast("int")) == F.when(F.size(small) > 0, F.sequence(start, start + F.size(small) - 1)))
    df = df.withColumn("_values", values).withColumn("_counted", ~F.col("_blank") & F.coalesce(counted, F.lit(False)))
    few = F.size(F.array_distinct("_values")) <= 2
    odd = ((F.size("cells") >= 4) & (F.size("_values") <= 2)) | (F.size("_values") >= 3) | (F.array_max(F.transform("_values", lambda v: F.length(v))) > 30)
    df = df.withColumn("_note", F.when(~F.col("_blank") & ~F.col("_counted") & (F.col("sig") != F.col("data_sig")) & few & odd, F.get("_values", F.lit(0))))
    again = F.coalesce((F.lag("_note").over(by) == F.col("_note")) & (F.lag("row").over(by) == F.col("row") - 1), F.lit(False))
    df = df.withColumn("_again", again).where(~F.col("_blank") & ~F.col("_counted") & ~F.col("_again"))
    note = F.col("_note").isNotNull()
    named = F.filter("headers", lambda h: h != "")
    loc = location(
        sheet_name=F.col("sheet_name"), table_index=F.col("table_index"), paragraph_seq=F.when(note, F.col("row")), anchor_text=F.when(note, F.substring("_note", 1, 20)),
        row_range=F.when(~note, F.concat(F.lit("r"), F.col("row").cast("string"))), column_names=F.when(~note & (F.size(named) > 0), named),
        column_names_confidence=F.when(note, "ok").otherwise(F.col("confidence")),
    )
    text = F.when(note, F.col("_note")).otherwise(row_text(F.col("headers"), F.col("cells")))
    return df.select(*key, F.col("row").alias("seq"), F.when(note, "paragraph").otherwise("table_row").alias("kind"), text.alias("text"), loc.alias("location"))
