"""Rows are gathered by one shuffle of the cells, and what rows pass on needs no further one."""

import re

from sheetloom.operators import columns, headers, rows
from sheetloom.sources.store import settle

CELLS = "workbook_id string, sheet_idx int, row int, col int, value_str string, value_num double, value_kind string"
HEADS = ["Code", "Image", "Location", "Label", "Details", "Qty"]


def _cells(spark, body):
    told = [("w", 0, 4, k, h, None, "str") for k, h in enumerate(HEADS, 1)] + [("w", 0, r, k, v, None, "str") for r, k, v in body]
    return spark.createDataFrame(told, CELLS)


def _read(spark, body):
    c = _cells(spark, body)
    h = settle(headers.find_header_row(c))
    return c, h, settle(columns.map_columns(c, h))


def _shuffles(df):
    return re.findall(r"hashpartitioning\(([^)]*)\)", df._jdf.queryExecution().executedPlan().toString())


def test_rows_are_shuffled_by_runs_alone(spark):
    wide = rows.wide_rows(*_read(spark, [(5, 1, "KITCHEN"), (6, 1, "P-1")]))
    shuffles = _shuffles(wide)
    assert shuffles and not [s for s in shuffles if re.search(r"\brow(_num)?#", s)]
    assert len(_shuffles(rows._in_runs(rows.classified(wide), rows._section()))) == len(shuffles)


def test_labels_with_blanks_and_items_beside_details(spark):
    body = [
        (5, 4, " Item: "), (5, 5, "Chair"), (6, 4, "MAKER: "), (6, 5, " Oak "), (7, 3, "Fabric:"), (7, 4, "Wool"), (7, 5, "size:"),
        (8, 4, "Finish:"), (9, 3, "item:"), (9, 4, "colour:"), (9, 5, "red"), (10, 2, "item:"), (10, 3, "Desk"),
    ]
    got = {x.row_num: x for x in rows.classified(rows.wide_rows(*_read(spark, body))).collect()}
    assert {r: got[r].kind for r in (5, 6, 7, 8, 9)} == {5: "item", 6: "detail", 7: "detail", 8: "detail", 9: "item"}
    assert [tuple(got[r].detail) for r in (6, 7, 8)] == [("maker", "Oak"), ("fabric", "Wool"), ("finish", None)]
    assert got[9].detail is None and got[9].item.value == "colour:" and got[10].item is None and got[10].item9.value == "Desk"
    assert [x.asDict() for x in got[7].labels] == [{"col": 3, "text": "fabric:"}, {"col": 5, "text": "size:"}]
