"""Word and spreadsheet files made from columns, for the queries of the readers: the tables hold none."""

from __future__ import annotations

import io
import zipfile
from html import escape

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
_S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def _zip(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def word_files(title: Column, number: Column) -> Column:
    """A title in two runs, a table of two rows whose second cell spans two columns, and a last paragraph."""

    @F.pandas_udf("binary")
    def make(titles: pd.Series, numbers: pd.Series) -> pd.Series:
        run = lambda t: f"<w:r><w:t>{escape(t)}</w:t></w:r>"
        cell = lambda t, span="": f"<w:tc>{span}<w:p>{run(t)}</w:p></w:tc>"
        wide = '<w:tcPr><w:gridSpan w:val="2"/></w:tcPr>'
        row = lambda a, b: f"<w:tr>{cell(a)}{cell(b, wide)}</w:tr>"
        bodies = (f"<w:p>{run(t[:2])}{run(t[2:])}</w:p><w:tbl>{row('项目', '数值')}{row('甲', n)}</w:tbl><w:p>{run('A&B 末段')}</w:p>" for t, n in zip(titles, numbers, strict=True))
        return pd.Series([_zip({"word/document.xml": f"<w:document {_W}><w:body>{b}</w:body></w:document>"}) for b in bodies])

    return make(title, number)


def sheet_files(name: Column, size: Column) -> Column:
    """A merged title, a row of text and numbers, an empty row, a number as text beside a flag, and a date beside a note."""

    @F.pandas_udf("binary")
    def make(names: pd.Series, sizes: pd.Series) -> pd.Series:
        text = lambda ref, t: f'<c r="{ref}" t="inlineStr"><is><t>{escape(t)}</t></is></c>'
        fixed = {
            "xl/workbook.xml": f'<workbook {_S}><sheets><sheet name="S" sheetId="1" r:id="rId1"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
            "xl/sharedStrings.xml": f"<sst {_S}><si><t>注</t></si></sst>",
            "xl/styles.xml": f'<styleSheet {_S}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
        }
        out = []
        for n, k in zip(names, sizes, strict=True):
            rows = (
                f'<row r="1">{text("A1", "价目")}</row><row r="2">{text("A2", n)}<c r="B2"><v>{k}</v></c><c r="C2"><v>{k % 90}.5</v></c></row>'
                f'<row r="4">{text("A4", "1,234%")}<c r="B4" t="b"><v>1</v></c></row><row r="5"><c r="A5" s="1"><v>43832</v></c><c r="B5" t="s"><v>0</v></c></row>'
            )
            out.append(_zip(fixed | {"xl/worksheets/sheet1.xml": f'<worksheet {_S}><sheetData>{rows}</sheetData><mergeCells><mergeCell ref="A1:C1"/></mergeCells></worksheet>'}))
        return pd.Series(out)

    return make(name, size)
