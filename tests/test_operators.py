from pyspark.sql import functions as F

from sheetloom.operators import grid, headers, naming, products

CELL = "workbook_id string, sheet_idx int, row int, col int, value_str string, value_num double, value_kind string"


def _cells(spark, values, workbook="w", sheet=0):
    return spark.createDataFrame([(workbook, sheet, r, c, v, None, "str") for (r, c), v in values.items()], CELL)


def _merges(spark, *areas):
    return spark.createDataFrame(
        [("w", 0, *a) for a in areas],
        "workbook_id string, sheet_idx int, min_row int, max_row int, min_col int, max_col int",
    )


def test_merged_range_takes_its_corner(spark):
    cells = _cells(spark, {(1, 1): "top", (2, 2): "hidden", (5, 1): "free", (6, 2): "gone"})
    got = {
        (r["row"], r["col"]): r["value_str"] for r in grid.fill_merged(
            cells,
            _merges(spark, (1, 2, 1, 2), (6, 6, 1, 2)),
        ).where("value_str is not null").collect()
    }
    assert got == {(1, 1): "top", (1, 2): "top", (2, 1): "top", (2, 2): "top", (5, 1): "free"}


def test_no_merges_and_no_cells(spark):
    cells = _cells(spark, {(1, 1): "a"})
    assert grid.fill_merged(cells, _merges(spark, (1, 1, 1, 1)).limit(0)).count() == 1
    assert grid.fill_merged(cells.limit(0), _merges(spark, (1, 1, 1, 2))).count() == 0
    assert grid.used_range(cells.limit(0)).count() == 0


def test_header_row_is_the_heaviest(spark):
    names = ["Product Code", "Item", "Qty", "Manufacturer"]
    cells = _cells(spark, {(1, 1): "Residence", (2, 1): "Qty", (2, 2): "Notes"} | {(4, k): n for k, n in enumerate(names, 1)})
    got = headers.find_header_row(cells).first()
    assert got["header_row"] == 4
    assert headers.find_header_row(_cells(spark, {(1, 1): "nothing", (2, 1): "here"})).count() == 0


def test_first_product_of_a_code_stays(spark):
    rows = [("w", 0, 7, "A"), ("w", 0, 5, " A "), ("w", 1, 1, "A"), ("w", 0, 9, None), ("w", 0, 8, ""), ("v", 0, 3, "A")]
    p = spark.createDataFrame(rows, "workbook_id string, sheet_idx int, row_num int, doc_code string")
    got = products.ordered_products(products.dedupe_by_doc_code(p)).collect()
    assert sorted((r["workbook_id"], r["row_num"], r["seq"]) for r in got) == [("v", 3, 1), ("w", 5, 1), ("w", 8, 2), ("w", 9, 3)]


def test_name_of_a_schedule(spark):
    sheet = "workbook_id string, filename string, sheet_idx int, sheet_name string, is_active boolean"
    sheets = spark.createDataFrame([("w", "house_one.xlsx", 0, "Items", True), ("v", "plain_file.xlsx", 0, "Items", True)], sheet)
    cells = _cells(spark, {(1, 1): "Interior Finishes Schedule"})
    got = {r["workbook_id"]: r["schedule_name"] for r in naming.schedule_name(cells, sheets).collect()}
    assert got == {"w": "Interior Finishes Schedule", "v": "plain file"}


def test_column_letters(spark):
    got = spark.createDataFrame([("A",), ("Z",), ("aa",)], "x string").select(naming.column_number(F.col("x")).alias("n")).collect()
    assert [r["n"] for r in got] == [1, 26, 27]
