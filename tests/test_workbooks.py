"""Workbooks read sheet by sheet: shared formulas, phonetic text, broken parts, long sheets."""

import io
import tracemalloc
import zipfile

import pytest
from books import xlsx

from sheetloom.sources import intake

_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"


def _with(book: bytes, parts: dict[str, str], packing: int = zipfile.ZIP_DEFLATED) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(book)) as old, zipfile.ZipFile(out, "w", packing) as new:
        for name in {*old.namelist(), *parts}:
            new.writestr(name, parts.get(name) or old.read(name))
    return out.getvalue()


def _sheet(rows: str, rest: str = "") -> str:
    return f'<worksheet xmlns="{_MAIN}"><sheetData>{rows}</sheetData>{rest}</worksheet>'


def _records(spark, files: dict[str, bytes]):
    rows = [(p, p, bytearray(c)) for p, c in files.items()]
    return intake.split_records(intake.read_workbooks(spark.createDataFrame(rows, "workbook_id string, filename string, content binary")))


@pytest.mark.parametrize(
    ("formula", "moved"),
    [
        ("=A1+$B$2", "=C4+$B$2"),
        ("=$A1&A$1", "=$A4&C$1"),
        ("=SUM(A1:B2)", "=SUM(C4:D5)"),
        ('="A1 "" B2"&Z9', '="A1 "" B2"&AB12'),
        ("='Sheet A1'!C3", "='Sheet A1'!E6"),
        ("=[1]AB1!A1", "=[1]AB1!C4"),
        ("=LOG10(B2)+Table[A1]", "=LOG10(D5)+Table[A1]"),
        ("=SUM(A:B)+SUM(2:$3)", "=SUM(C:D)+SUM(5:$3)"),
        ("=rate1.A1+XAB12", "=rate1.A1+XAD15"),
    ],
)
def test_moved_formulas(formula, moved):
    assert intake.moved_formula(formula, 3, 2) == moved


def test_a_formula_that_leaves_the_sheet():
    assert intake.moved_formula("=A1+B2", -1, 0) == "=#REF!+B1"
    assert intake.moved_formula("=B2", 0, -1) == "=A2" and intake.moved_formula("=A2", 0, -1) == "=#REF!"


@pytest.mark.parametrize("packing", [zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED])
def test_shared_formulas_and_phonetic_text(spark, packing):
    rows = (
        '<row r="1"><c r="A1"><f t="shared" ref="A1:A3" si="0">B1*$C$1</f><v>5</v></c><c r="B1" t="s"><v>0</v></c></row>'
        '<row r="2"><c r="A2"><f t="shared" si="0"/><v>6</v></c><c t="inlineStr"><is><t>in</t><rPh sb="0" eb="1"><t>no</t></rPh></is></c></row>'
        '<row><c><f t="shared" si="0"/></c><c><v>7</v></c></row>'
    )
    texts = f'<sst xmlns="{_MAIN}"><si><r><t>two </t></r><r><t>runs</t></r><rPh sb="0" eb="2"><t>spoken</t></rPh><phoneticPr fontId="1"/></si></sst>'
    book = _with(xlsx({"S": [["x"]]}), {"xl/worksheets/sheet1.xml": _sheet(rows), "xl/sharedStrings.xml": texts}, packing)
    got = {(r["row"], r["col"]): r["value_str"] for r in _records(spark, {"a": book})["cells"].collect()}
    assert got == {(1, 1): "=B1*$C$1", (1, 2): "two runs", (2, 1): "=B2*$C$1", (2, 2): "in", (3, 1): "=B3*$C$1", (3, 2): "7"}


def test_a_broken_sheet_takes_its_workbook_alone(spark):
    good = xlsx({"One": [["a"]], "Two": [["b"]]}, {"Two": ["A1:B1"]})
    cut = _with(good, {"xl/worksheets/sheet2.xml": f'<worksheet xmlns="{_MAIN}"><sheetData><row r="1"><c r="A1"><v>1</v></c></row>'})
    both = _with(cut, {"xl/worksheets/sheet1.xml": _sheet('<row r="1"><c r="A1" t="s"><v>4</v></c></row>')})
    lost = _with(good, {"xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"/>'})
    flipped = bytearray(good)
    flipped[good.index(b">a<") + 1] ^= 1  # stored, so the text itself changes and the checksum doesn't
    parts = _records(spark, {"good": good, "cut": cut, "both": both, "lost": lost, "flipped": bytes(flipped)})
    assert sorted((r["workbook_id"], r["value_str"]) for r in parts["cells"].collect()) == [("good", "a"), ("good", "b")]
    assert {r["workbook_id"] for r in parts["sheets"].collect()} == {r["workbook_id"] for r in parts["merges"].collect()} == {"good"}
    errors = {r["workbook_id"]: r["detail"] for r in parts["errors"].collect()}
    assert parts["errors"].count() == 4 and set(errors) == {"cut", "both", "lost", "flipped"}
    assert errors["both"].startswith("IndexError") and errors["flipped"].startswith("BadZipFile") and errors["lost"].startswith("KeyError")


def test_memory_does_not_grow_with_the_sheet():
    def peak(lines: int) -> tuple[int, int]:
        book = _with(xlsx({"S": [["x"]]}), {"xl/worksheets/sheet1.xml": _sheet("".join(f'<row r="{r}"><c r="A{r}"><v>{r}</v></c><c r="B{r}"><v>2</v></c></row>' for r in range(1, lines + 1)))})
        (part,) = intake.sheet_parts("w", "f", book)
        del book
        tracemalloc.start()
        n = sum(1 for _ in intake.sheet_records(part))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return n, most

    (few, low), (many, high) = peak(40_000), peak(160_000)
    assert (few, many) == (80_001, 320_001) and high < 1.3 * low
