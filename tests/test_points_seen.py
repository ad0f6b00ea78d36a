"""Points meet ranges row by row, in one shuffle; sheets with large ranges are looked up by tiles."""

import random

from sheetloom.operators import grid

CELLS = "workbook_id string, sheet_idx int, row int, col int, value_str string, value_num double, value_kind string"
MERGES = "workbook_id string, sheet_idx int, min_row int, max_row int, min_col int, max_col int"


def test_points_are_shuffled_once_for_ranges(spark):
    m = spark.range(500).selectExpr("'w' workbook_id", "0 sheet_idx", "cast(3 * id + 1 as int) min_row", "cast(3 * id + 2 as int) max_row", "35 min_col", "cast(35 + id % 40 as int) max_col")
    points = m.selectExpr("workbook_id", "sheet_idx", "min_row as row", "36 as col")
    plan = grid.merged_range_of(points, m)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2, plan  # the points and the ranges


def test_large_ranges_beside_small_ones(spark):
    r = random.Random(5)
    areas = {0: [(1, 900, 1, 2), (1, 1, 4, 2000), (5, 7, 5, 80), (9, 9, 70, 70)], 1: [(2, 20, 3, 140), (30, 30, 64, 65)], 2: []}
    values = {(s, a[0], a[2]): f"r{s}{k}" for s, found in areas.items() for k, a in enumerate(found) if k != 3} | {(2, 4, 4): "own", (0, 9, 71): "next", (1, 5, 5): "hidden"}
    cells = spark.createDataFrame([("w", s, a, b, v, None, "str") for (s, a, b), v in values.items()], CELLS)
    merges = spark.createDataFrame([("w", s, *a) for s, found in areas.items() for a in found], MERGES)
    asked = {(s, r.randrange(1, 40), r.choice([1, 2, 3, 4, 5, 64, 65, 66, 70, 71, 80, 81, 128, 140, 141, 1999])) for s in (0, 1, 2) for _ in range(150)} | {(2, 4, 4), (0, 9, 70), (0, 9, 71), (1, 5, 5)}
    points = spark.createDataFrame([("w", *p) for p in asked], "workbook_id string, sheet_idx int, row int, col int")
    over = lambda s, a, b: next((x for x in areas[s] if x[0] <= a <= x[1] and x[2] <= b <= x[3]), None)
    want = {p: (over(*p) or (None,) * 4, values.get((p[0], *(over(*p)[0::2] if over(*p) else p[1:])))) for p in asked}
    got = {(x.sheet_idx, x.row, x.col): ((x.min_row, x.max_row, x.min_col, x.max_col), x.value_str) for x in grid.points_seen(points, cells, merges).collect()}
    assert got == want
    assert {(x.sheet_idx, x.row, x.col) for x in grid.is_merged(points, merges).collect()} == {p for p in asked if over(*p)}
    assert {(x.sheet_idx, x.row, x.col): x.min_row for x in grid.merged_range_of(points, merges).collect()} == {p: w[0][0] for p, w in want.items()}
