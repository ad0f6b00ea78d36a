"""Points and references meet only the cells at their places."""

from pyspark.sql import functions as F

from sheetloom.operators import grid, naming
from sheetloom.sources.store import settle

CELLS = "workbook_id string, sheet_idx int, row int, col int, value_str string, value_num double, value_kind string"


def _grid(spark, found):
    return spark.createDataFrame([(b, s, r, c, v, None, "str") for b, s, r, c, v in found], CELLS)


def test_cells_elsewhere_stay_out_of_the_join(spark):
    cells = spark.range(20_000).select(F.lit("b").alias("workbook_id"), F.lit(0).alias("sheet_idx"), (F.col("id") + 1).cast("int").alias("row"), F.lit(1).alias("col"))
    spots = settle(cells.where("row % 1000 = 0").select(F.col("row").alias("at_row"), F.col("col").cast("long").alias("at_col")))
    met = grid.at_places(cells, spots, "at_row", "at_col")
    assert met.where("row % 1000 = 0").count() == 20
    assert met.count() < 100
    assert grid.at_places(cells, spots.limit(0), "at_row", "at_col").count() == 0


def test_references_of_some_cells_find_titles_anywhere(spark):
    cells = _grid(
        spark,
        [("b", 0, 1, 1, "=Other!$C$70"), ("b", 0, 2, 1, "='other '!C70"), ("b", 0, 3, 1, "=Other!C71"), ("b", 0, 40, 5, "=Other!C70"), ("b", 0, 4, 1, "=None!A1"), ("b", 1, 70, 3, " Tower Finish Schedule "), ("b", 1, 71, 3, "17"), ("c", 1, 70, 3, "Another Finish Schedule")],
    )
    sheets = spark.createDataFrame([("b", "b.xlsx", 0, "Main", True), ("b", "b.xlsx", 1, "Other", False)], "workbook_id string, filename string, sheet_idx int, sheet_name string, is_active boolean")
    told = lambda df: sorted((r.row, r.col, r.target) for r in df.collect())
    title = "Tower Finish Schedule"
    assert told(naming.resolve_cell_refs(cells, sheets)) == [(1, 1, title), (2, 1, title), (40, 5, title)]
    assert told(naming.resolve_cell_refs(cells, sheets, cells.where("row = 2"))) == [(2, 1, title)]
    assert [tuple(r) for r in naming.schedule_name(cells, sheets).collect()] == [("b", title)]
    no_refs = cells.where("not startswith(value_str, '=')")
    assert [tuple(r) for r in naming.schedule_name(no_refs, sheets).collect()] == [("b", "b")]


def test_section_points_write_no_grid(spark, monkeypatch):
    from sheetloom.jobs import queries

    monkeypatch.setattr(queries, "_cells", lambda *_: 1 / 0)
    assert queries.merged_points(spark, "/root/testdata/sf0.001").count() > 0
