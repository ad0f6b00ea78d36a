"""Small `.xlsx` files for tests, written part by part."""

import io
import zipfile
from xml.sax.saxutils import escape

_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_DOC = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006/relationships"


#: Formats of the styles 1 to 4: a built-in date, a built-in time, a date of its own, and digits beside quoted letters.
_STYLES = (
    f'<styleSheet xmlns="{_MAIN}"><numFmts><numFmt numFmtId="164" formatCode="dd/mm/yyyy\\ hh:mm"/><numFmt numFmtId="165" formatCode="0&quot; days&quot;"/></numFmts>'
    '<cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="21"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs></styleSheet>'
)


def _cell(ref, value, style=0):
    if isinstance(value, bool):
        return f'<c r="{ref}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, int | float):
        return f'<c r="{ref}" s="{style}"><v>{value}</v></c>'
    return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(value)}</t></is></c>'


def xlsx(sheets: dict[str, list[list]], merges: dict[str, list[str]] | None = None, styles: dict[str, int] | None = None) -> bytes:
    """A workbook of the sheets' rows; None is no cell. `styles` are numbers by place, alike in all sheets."""
    styles = styles or {}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        tabs, links = [], []
        for k, (name, rows) in enumerate(sheets.items(), 1):
            tabs.append(f'<sheet name="{escape(name)}" sheetId="{k}" r:id="rId{k}"/>')
            links.append(f'<Relationship Id="rId{k}" Type="{_DOC}/worksheet" Target="worksheets/sheet{k}.xml"/>')
            lines = []
            for r, row in enumerate(rows, 1):
                cells = [_cell(f"{chr(64 + c)}{r}", v, styles.get(f"{chr(64 + c)}{r}", 0)) for c, v in enumerate(row, 1) if v is not None]
                lines.append(f'<row r="{r}">{"".join(cells)}</row>')
            areas = "".join(f'<mergeCell ref="{m}"/>' for m in (merges or {}).get(name, []))
            areas = areas and f"<mergeCells>{areas}</mergeCells>"
            z.writestr(f"xl/worksheets/sheet{k}.xml", f'<worksheet xmlns="{_MAIN}"><sheetData>{"".join(lines)}</sheetData>{areas}</worksheet>')
        z.writestr("xl/styles.xml", _STYLES)
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{_MAIN}" xmlns:r="{_DOC}"><sheets>{"".join(tabs)}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{_PACKAGE}">{"".join(links)}</Relationships>')
    return out.getvalue()
