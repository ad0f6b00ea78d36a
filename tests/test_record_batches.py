"""Records of sheets are made as columns, small batches are put together."""

import pyarrow as pa
from books import xlsx

from sheetloom.sources import intake


def test_records_are_columns_of_one_sheet():
    parts = intake.sheet_parts("w", "f.xlsx", xlsx({"S": [["a", 2], ["b", 3]], "T": [["c"]]}))
    batches = [intake._record_batch(p, list(intake.sheet_records(p))) for p in parts]
    told = [(r["record_type"], r["workbook_id"], r["sheet_idx"], r["sheet_name"], r["row"], r["col"], r["value_str"], r["error"]) for b in batches for r in b.to_pylist()]
    assert [t for t in told if t[0] != "merge"] == [
        ("sheet", "w", 0, "S", None, None, None, None),
        *[("cell", "w", 0, None, *c, None) for c in ((1, 1, "a"), (1, 2, "2"), (2, 1, "b"), (2, 2, "3"))],
        ("sheet", "w", 1, "T", None, None, None, None),
        ("cell", "w", 1, None, 1, 1, "c", None),
    ]


def test_small_batches_are_put_together():
    small = [pa.RecordBatch.from_pydict({"n": [k, k]}) for k in range(10)]
    got = list(intake._gathered(iter(small), 6, 1 << 20))
    assert [b.num_rows for b in got] == [6, 6, 6, 2]
    assert [n for b in got for n in b.column("n").to_pylist()] == [k for k in range(10) for _ in range(2)]
    assert [b.num_rows for b in intake._gathered(iter(small), 6, 1)] == [2] * 10
    assert list(intake._gathered(iter(()), 6, 1)) == []


def test_formulas_are_cut_once():
    parts = intake.formula_parts("=$A1+'B2'!C$3&\"D4\"+5:6+E:$F")
    assert intake.moved_parts(parts, 2, 1) == "=$A3+'B2'!D$3&\"D4\"+7:8+F:$F"
    assert intake.moved_parts(parts, -5, 0) == "=#REF!+'B2'!C$3&\"D4\"+#REF!+E:$F"
