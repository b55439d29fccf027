"""Word and spreadsheet files made from scratch, for the readers."""

import io
import zipfile

_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
_S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def _zip(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


def word_file(parts):
    """parts: paragraphs as text, tables as lists of rows."""
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    body = "".join(p(x) if isinstance(x, str) else "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in row) + "</w:tr>" for row in x) + "</w:tbl>" for x in parts)
    return _zip({"word/document.xml": f"<w:document {_W}><w:body>{body}</w:body></w:document>"})


def sheet_file(rows, merged=(), name="表一"):
    """rows of cells: None, numbers or text."""
    def cell(r, c, v):
        ref = f"{chr(65 + c)}{r}"
        if v is None:
            return ""
        if isinstance(v, (int, float)):
            return f'<c r="{ref}"><v>{v}</v></c>'
        return f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>'

    data = "".join(f'<row r="{r}">' + "".join(cell(r, c, v) for c, v in enumerate(row)) + "</row>" for r, row in enumerate(rows, 1))
    spans = f"<mergeCells>{''.join(f'<mergeCell ref="{m}"/>' for m in merged)}</mergeCells>" if merged else ""
    return _zip({
        "xl/workbook.xml": f'<workbook {_S}><sheets><sheet name="{name}" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f"<worksheet {_S}><sheetData>{data}</sheetData>{spans}</worksheet>",
    })


LAW = "标题：税收征管办法\n发布日期：2019-01-02\n来源：总局\n原文链接：http://x.y/z\n正文：\n无障碍浏览\n目 录\n第一章 总则\n第二章 附则\n2020年3月4日公布\n第一章　总则\n第一条 为了规范征管。\n续行说明。\n第一节 范围\n第二条 本办法适用于全国。\n第二章 附则\n第三条 自2021年1月1日起施行。\n"
GRID = [["汇率表", "汇率表", "汇率表", "汇率表"], ["币种", "买入", "卖出", "日期"], [1, 2, 3, 4], ["美元", 6.5, 6.6, "2020"], ["欧元", 7.5, 7.6, "2021"], ["日元", 0.05, 0.06, "2021"], [None] * 4, [None] * 4, ["英镑", 8.5, 8.6, "2022"], ["注：仅供参考", None, None, None], ["注：仅供参考", None, None, None]]
