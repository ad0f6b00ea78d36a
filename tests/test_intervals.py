"""Merged ranges as intervals, and rows carried over runs, held against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from sheetloom.functions import units
from sheetloom.operators import grid, naming, products, rows

CELL = "workbook_id string, sheet_idx int, row int, col int, value_str string, value_num double, value_kind string"
MERGE = "workbook_id string, sheet_idx int, min_row int, max_row int, min_col int, max_col int"


def cells(spark, values, sheet=0):
    return spark.createDataFrame([("w", sheet, r, c, v, None, "str") for (r, c), v in values.items()], CELL)


def merges(spark, *areas):
    return spark.createDataFrame([("w", 0, *a) for a in areas], MERGE)


def areas(r, n, rows, cols):
    """Up to n ranges that don't overlap."""
    taken, out = set(), []
    for _ in range(n):
        a, c = r.randrange(1, rows), r.randrange(1, cols)
        b, d = a + r.choice([0, 0, 1, 2, 17]), c + r.choice([0, 1, 3, 40])
        own = {(i, j) for i in range(a, b + 1) for j in range(c, d + 1)}
        if not own & taken:
            taken |= own
            out.append((a, b, c, d))
    return out


def test_ranges_match_a_plain_version(spark):
    r = random.Random(3)
    found = areas(r, 120, 60, 80)
    values = {(r.randrange(1, 80), r.randrange(1, 130)): f"v{k}" for k in range(900)}
    points = {(r.randrange(1, 85), r.randrange(1, 130)) for _ in range(1500)}
    over = {(i, j): a for a in found for i in range(a[0], a[1] + 1) for j in range(a[2], a[3] + 1)}
    want = {p: v for p, v in values.items() if p not in over}
    want |= {p: values[a[0], a[2]] for p, a in over.items() if (a[0], a[2]) in values}
    c, m = cells(spark, values), merges(spark, *found)
    assert {(x.row, x.col): x.value_str for x in grid.fill_merged(c, m).collect()} == want
    assert {(x.row, x.col): x.value_str for x in grid.fill_merged(c, m, last_row=20).collect()} == {p: v for p, v in want.items() if p[0] <= 20}
    p = spark.createDataFrame([("w", k, *x, 7) for x in points for k in (0, 1)], "workbook_id string, sheet_idx int, row int, col int, other int")
    got = grid.merged_range_of(p, m).collect()
    assert len(got) == 2 * len(points)
    for x in got:
        assert (x.min_row, x.max_row, x.min_col, x.max_col) == (over.get((x.row, x.col), (None,) * 4) if x.sheet_idx == 0 else (None,) * 4)
    assert {(x.row, x.col) for x in grid.is_merged(p, m).collect()} == points & set(over)
    seen = {(x.row, x.col): x.value_str for x in grid.merged_value(p, c, m).where("sheet_idx = 0").collect()}
    assert seen == {q: want.get(q) for q in points}


def test_ranges_past_the_columns_that_rules_read(spark):
    c = cells(spark, {(1, 1): "wide", (5, 35): "far", (9, 1): "row", (12, 60): "last"})
    got = grid.fill_merged(c, merges(spark, (1, 1, 1, 40), (5, 6, 35, 36), (9, 9, 1, 16_384)))
    n = {x.value_str: x.n for x in got.groupBy("value_str").agg(F.count("*").alias("n")).collect()}
    assert n == {"wide": 40, "far": 4, "row": 60, "last": 1}


def test_overlapping_ranges_take_the_greatest_corner(spark):
    c = cells(spark, {(1, 1): "a", (2, 2): "b"})
    got = {(x.row, x.col): x.value_str for x in grid.fill_merged(c, merges(spark, (1, 3, 1, 3), (2, 4, 2, 2))).collect()}
    assert got == {(i, j): "b" if j == 2 and i >= 2 else "a" for i in range(1, 4) for j in range(1, 4)} | {(4, 2): "b"}


def test_many_ranges_in_one_sheet_ask_few_tiles(spark):
    """A hundred thousand ranges in one sheet, twenty thousand of them side by side in three rows."""
    m = spark.range(80_000).selectExpr("'w' AS workbook_id", "0 AS sheet_idx", "CAST(id + 10 AS INT) AS min_row", "CAST(id + 10 AS INT) AS max_row", "1 AS min_col", "3 AS max_col")
    beside = spark.range(20_000).selectExpr("'w' AS workbook_id", "0 AS sheet_idx", "CAST(id % 3 + 1 AS INT) AS min_row", "CAST(id % 3 + 1 AS INT) AS max_row", "CAST((id div 3) * 2 + 1 AS INT) AS min_col", "CAST((id div 3) * 2 + 2 AS INT) AS max_col")
    m = m.unionByName(beside)
    p = m.selectExpr("workbook_id", "sheet_idx", "min_row AS row", "max_col AS col")
    met = grid.merged_range_of(p, m)
    assert met.where("row = min_row and col = max_col").count() == 100_000
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def _rows(spark, kinds, run_sheet=0):
    data = [("w", run_sheet, 3 * k + 5, kind, f"S{k}" if kind == "section" else None) for k, kind in enumerate(kinds)]
    return spark.createDataFrame(data, "workbook_id string, sheet_idx int, row_num int, kind string, section_name string")


@pytest.mark.parametrize("run", [1, 4, 50, 10_000])
def test_sections_are_carried_over_runs(spark, run):
    r = random.Random(run)
    kinds = [r.choices(["section", "item", "detail", "other"], [1, 3, 9, 9])[0] for _ in range(160)]
    both = _rows(spark, kinds).unionByName(_rows(spark, ["other", "section", "detail"], 1))
    got = {(x.sheet_idx, x.row_num): x.section for x in rows.fill_section(both, run).collect()}
    want, last = {}, None
    for k, kind in enumerate(kinds):
        last = f"S{k}" if kind == "section" else last
        want[0, 3 * k + 5] = last
    assert got == want | {(1, 5): None, (1, 8): "S1", (1, 11): "S1"}


@pytest.mark.parametrize("run", [1, 7, 10_000])
def test_details_go_to_the_item_above_over_runs(spark, run):
    r = random.Random(run)
    kinds = [r.choices(["section", "item", "detail", "other"], [1, 3, 12, 4])[0] for _ in range(200)]
    cell = "CAST(NULL AS STRUCT<value_str: STRING, value_num: DOUBLE, value_kind: STRING>)"
    made = rows.fill_section(_rows(spark, kinds), run).selectExpr(
        "*", "named_struct('key', 'k', 'value', CAST(row_num AS STRING)) AS detail", "CAST(NULL AS STRUCT<value: STRING>) AS item", "CAST(NULL AS STRUCT<value: STRING>) AS item9", *[f"{cell} AS {n}" for n in rows.CANONICALS]
    )
    got = {x.row_num: (x.section, [int(d.value) for d in x.detail_rows]) for x in rows.grouped_rows(made, run).collect()}
    want, section, item = {}, None, None
    for k, kind in enumerate(kinds):
        at = 3 * k + 5
        if kind == "section":
            section, item = f"S{k}", None
        elif kind == "item":
            item = at
            want[at] = (section, [])
        elif kind == "detail" and item:
            want[item][1].append(at)
    assert got == want


def test_mapped_columns_are_read_wherever_they_are(spark):
    head = {(1, 1): "Code", (1, 40): "Qty", (1, 45): "Other"}
    c = cells(spark, head | {(2, 1): "A", (2, 40): "3", (2, 45): "no"})
    h = spark.createDataFrame([("w", 0, 1)], "workbook_id string, sheet_idx int, header_row int")
    cm = spark.createDataFrame([("w", 0, "doc_code", 1), ("w", 0, "qty", 40)], "workbook_id string, sheet_idx int, canonical string, col int")
    for m, want in ((None, "3"), (merges(spark, (2, 3, 40, 41)), "3")):
        got = {x.row_num: x for x in rows.wide_rows(c, h, cm, merges=m).collect()}
        assert got[2].qty.value_str == want and sorted(got[2].c) == [1, 40]
        assert (3 in got) == (m is not None)


def test_filling_while_rows_are_built_changes_nothing(spark):
    r = random.Random(11)
    values = {(r.randrange(1, 60), r.randrange(1, 12)): f"v{k}" for k in range(350)}
    c, m = cells(spark, values), merges(spark, *areas(r, 60, 60, 12), (3, 3, 20, 28))
    h = spark.createDataFrame([("w", 0, 2)], "workbook_id string, sheet_idx int, header_row int")
    cm = spark.createDataFrame([("w", 0, "doc_code", 1), ("w", 0, "qty", 6)], "workbook_id string, sheet_idx int, canonical string, col int")
    told = lambda df: {x.row_num: (x.doc_code, x.qty, x.c) for x in df.collect()}
    assert told(rows.wide_rows(c, h, cm, 40, merges=m)) == told(rows.wide_rows(grid.fill_merged(c, m), h, cm, 40))


def test_numbers_next_to_a_unit(spark):
    values = {
        "100 X 200 X 300 X 400 MM": (200, 300, 400),
        "60 W X 60 H X 2 CM": (60, None, 60),
        "60 W X 50 H CM": (600, None, 500),
        "5 X 60 W X 50 H CM": (600, None, 500),
        "60 W X 10 X 20 MM": (10, 20, None),
        "1 W X 2 D X 3 H X 4 T CM": (1, 2, 3),
        "2 X 3 M": (2000, 3000, None),
        "2 X 3": (None, None, None),
    }
    got = spark.createDataFrame([(v,) for v in values], "x string").select("x", units.parse_dimensions(F.col("x")).alias("d")).collect()
    assert {x.x: tuple(x.d) for x in got} == values


def test_prices_names_images_and_references(spark):
    prices = {"$ 25+GST": 25.0, "costs $x, $1,234.5 each": 1234.5, "unitcost: 12": 12.0, "Price (ex GST) 1,200": 1200.0, "RRP to be confirmed in due course 12": None, "n/a": None, " - ": None, "POA": None, "POA $5": 5.0, "12": None}
    got = spark.createDataFrame([(v,) for v in prices], "x string").select("x", units.parse_price(F.col("x")).alias("r")).collect()
    assert {x.x: x.r for x in got} == prices
    names = {"House (FF&E Tracker) ": "House", "House (ffe  TRACKER)": "House", "House (FFE)": "House (FFE)", "A (b) (FFEtracker)": "A (b)", "(FFE Tracker)": "", "tracker)": "tracker)"}
    got = spark.createDataFrame([(v,) for v in names], "x string").select("x", naming.clean_schedule_name(F.col("x")).alias("r")).collect()
    assert {x.x: x.r for x in got} == names
    images = {"http://x.com/a/TAP-1.PNG?size=2": "TAP-1", "/a b.jpg": None, "tap.png": None, "x/y.jpgs/z.webp": "z", "/i/one.two.jpeg/k.gif": "one.two", "/" + "n" * 31 + ".png": None}
    got = spark.createDataFrame([(v,) for v in images], "x string").select("x", products.code_in_image(F.col("x")).alias("r")).collect()
    assert {x.x: x.r for x in got} == images
    refs = {"=Items!A6": ("Items", "A", "6"), "= '[1]Cover Sheet'!$AB$12": ("Cover Sheet", "AB", "12"), "=[2]Items!b3": ("Items", "b", "3"), "=A1": None, "=Items!A1+1": None, "=Items!A1:B2": None, "=x!y!A1": None, "='it''s'!A1": None, "Items!A6": None}
    got = spark.createDataFrame([(v,) for v in refs], "x string").select("x", naming.reference_parts(F.col("x")).alias("r")).collect()
    assert {x.x: tuple(x.r) if x.r else None for x in got} == refs


def test_packed_grids_stay_off_the_driver(spark, tmp_path):
    """A grid that is small on disk has many rows in memory: joins with it, and with as many ranges, shuffle it."""
    spark.range(200_000).selectExpr("'b' workbook_id", "0 sheet_idx", "cast(id + 1 as int) row", "1 col", "'x' value_str", "cast(null as double) value_num", "'str' value_kind").write.parquet(f"{tmp_path}/c")
    c = spark.read.parquet(f"{tmp_path}/c")
    spark.range(200_000).selectExpr("'b' workbook_id", "0 sheet_idx", "cast(id + 1 as int) min_row", "cast(id + 1 as int) max_row", "1 min_col", "3 max_col").write.parquet(f"{tmp_path}/m")
    m = spark.read.parquet(f"{tmp_path}/m")
    points = c.select(*grid.SHEET, "row", F.lit(2).alias("col"))
    for made, n in ((grid.merged_value(points, c, m), 200_000), (grid.is_merged(points, m), 200_000), (grid.is_merged_topleft(points, m), 0), (grid.range_rows(c, m), 200_000)):
        assert made.count() == n
        plan = made._jdf.queryExecution().sparkPlan().toString()
        assert not [line for line in plan.splitlines() if "BroadcastHashJoin" in line and "row" in line], plan
