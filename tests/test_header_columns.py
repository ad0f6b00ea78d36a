"""Header rows and their columns from one pass; texts are cut apart once."""

import pytest
from pyspark.sql import functions as F

from sheetloom.operators import columns, headers, products

CELLS = "workbook_id string, sheet_idx int, row int, col int, value_str string, value_num double, value_kind string"


def _cells(spark, found):
    return spark.createDataFrame([("w", s, r, c, v, None, "str") for s, r, c, v in found], CELLS)


def test_header_columns_from_one_pass(spark):
    c = _cells(spark, [(0, 4, 2, "Code"), (0, 4, 1, "Qty"), (0, 4, 5, "Quantity"), (0, 9, 1, "Notes"), (1, 2, 3, "Product Name"), (1, 2, 4, "Room"), (1, 3, 1, "Code"), (1, 3, 7, "Price"), (2, 1, 1, "nothing")])
    got = {(r.sheet_idx, r.header_row, r.canonical, r.col) for r in headers.find_header_columns(c).collect()}
    h = headers.find_header_row(c)
    want = headers.header_columns(c, h).join(h.select("workbook_id", "sheet_idx", "header_row"), ["workbook_id", "sheet_idx"])
    assert got == {(r.sheet_idx, r.header_row, r.canonical, r.col) for r in want.collect()}
    assert (0, 4, "qty", 1) in got and (1, 3, "cost", 7) in got


@pytest.mark.parametrize("sheets", [3, columns.FEW + 5])
def test_header_cells_of_few_and_of_many_rows(spark, sheets):
    c = _cells(spark, [x for s in range(sheets) for x in ((s, s + 1, 1, f"  Head\n{s}:"), (s, s + 1, 2, " :"), (s, s + 2, 1, "below"), (s, s + 1, 31, "far"))])
    h = spark.createDataFrame([("w", s, s + 1) for s in range(sheets)], "workbook_id string, sheet_idx int, header_row int")
    got = sorted((r.sheet_idx, r.col, r.norm) for r in columns.header_cells(c, h).collect())
    assert got == [(s, 1, f"head {s}") for s in range(sheets)]
    assert columns.header_cells(c, h.limit(0)).count() == 0


def test_texts_are_cut_as_before(spark):
    texts = ["Lamp for Room 1", "Lamp FOR\tHall for Room", " for x", "x for ", "forum", None, "a for  b for c", "Lamp for Room", "P1 – x: y", "P1 - ", "a: b", "x" * 40 + " - y: z", "a/b/img.PNG", "img.png", "/x y.jpg", "h//one.jpg/two.png"]
    t = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k int, x string").select("x", products.split_item_location(F.col("x")).alias("at"), products.code_in_name(F.col("x")).alias("name"), products.code_in_image(F.col("x")).alias("image"))
    at = {r.x: tuple(r["at"]) for r in t.collect() if r["at"]}
    assert at == {"Lamp for Room 1": ("Lamp", "Room 1"), "a for  b for c": ("a", "b for c"), "Lamp FOR\tHall for Room": ("Lamp", "Hall for Room")}
    assert {r.x: tuple(r["name"]) for r in t.collect() if r["name"]} == {"P1 – x: y": ("P1", "x: y"), "a: b": ("a", "b")}
    assert {r.x: r["image"] for r in t.collect() if r["image"]} == {"a/b/img.PNG": "img", "h//one.jpg/two.png": "one"}


def test_text_rules_are_one_projection(spark):
    from sheetloom.jobs import queries

    plan = queries.text_rules(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan
