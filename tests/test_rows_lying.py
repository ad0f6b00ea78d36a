"""Cells of a table that lies by sheet are gathered where they are made, and the grid is not written."""

import re

import pytest

from sheetloom.jobs import queries
from sheetloom.operators import columns, grid, headers, rows
from sheetloom.sources.store import settle

CELLS = "workbook_id string, sheet_idx int, row int, col int, value_str string, value_num double, value_kind string"
MERGES = "workbook_id string, sheet_idx int, min_row int, max_row int, min_col int, max_col int"
HEADS = ["Code", "Image", "Location", "Label", "Details", "Qty"]
SF = "/root/testdata/sf0.001"


def _grid(spark):
    body = {
        0: [(5, 1, "KITCHEN"), (6, 1, "P-1"), (6, 6, "2"), (7, 3, "Room 1"), (8, 1, "BATH"), (30, 1, "P-2")],
        1: [(5, 4, "Item:"), (5, 5, "Chair"), (6, 4, "Maker:"), (6, 5, "Oak"), (7, 4, "Item:"), (7, 5, "Desk"), (8, 4, "Size:"), (8, 5, "3")],
    }
    told = [("w", s, 4, k, h, None, "str") for s in body for k, h in enumerate(HEADS, 1)]
    told += [("w", s, r, k, v, None, "str") for s, found in body.items() for r, k, v in found]
    cells = spark.createDataFrame(told, CELLS)
    merges = spark.createDataFrame([("w", 0, 8, 8, 1, 7), ("w", 0, 7, 9, 3, 3)], MERGES)
    h = settle(headers.find_header_row(cells, merges=merges))
    return cells, merges, h, settle(columns.map_columns(cells, h, merges=merges))


def test_rows_that_lie_by_sheet_are_the_same(spark):
    cells, merges, h, mapped = _grid(spark)
    for limit in (None, 20):
        plain = rows.product_rows(cells, h, mapped, limit, merges)
        lying = rows.product_rows(cells, h, mapped, limit, merges, lying=grid.by_sheet(cells))
        told = lambda df: sorted((r.sheet_idx, r.row_num, r.section, r.item_name, str(r.detail_rows), str(r.doc_code), str(r.item_location), str(r.qty)) for r in df.collect())
        assert told(plain) == told(lying)
        assert [(r[0], r[1]) for r in told(lying)] == [(0, 6), (0, 7), (0, 9), *([(0, 30)] if limit is None else []), (1, 5), (1, 7)]
        few = rows.product_rows(cells, h, mapped, limit, merges, keep=["qty"], lying=grid.by_sheet(cells))
        assert "qty" in few.columns and "specs" not in few.columns and few.count() == lying.count()


def test_lying_cells_are_not_shuffled_again(spark):
    cells, merges, h, mapped = _grid(spark)
    plan = rows.wide_rows(cells, h, mapped, 20, merges, grid.by_sheet(cells))._jdf.queryExecution().executedPlan().toString()
    keys = re.findall(r"hashpartitioning\(([^)]*)\)", plan)
    assert keys and all(re.fullmatch(r"workbook_id#\d+, sheet_idx#\d+, \d+", k) for k in keys), keys
    assert re.search(r"row#\d+ <= 24", plan)  # the rows beyond are not gathered


@pytest.mark.parametrize("name", ["merged_fill", "messy_rows", "row_kinds", "product_counts_limited"])
def test_the_grid_is_not_written(spark, monkeypatch, name):
    written = []
    monkeypatch.setattr(queries, "settle", lambda df: written.append(df.columns) or settle(df))
    queries.QUERIES[name](spark, SF)
    assert written and not [c for c in written if "value_str" in c]
