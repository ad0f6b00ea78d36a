"""A band that meets no other of its row is filled as one stretch."""

import random

from pyspark.sql import functions as F

from sheetloom.operators import grid

BANDS = "id int, bands array<struct<min_row: int, min_col: int, max_col: int, value_str: string, value_num: double, value_kind: string, held: boolean>>"


def test_bands_are_told_as_stretches(spark):
    r, rows = random.Random(8), []
    for k in range(200):
        rows.append((k, [(r.randrange(1, 4), c, c + r.choice([0, 2, 9, 40]), f"v{j}", None, "str", r.random() < 0.8) for j, c in enumerate(r.sample(range(1, 200), r.randrange(1, 5)))]))
    rows.append((1000, [(1, 5, 16_000, "one", None, "str", True), (2, 1, 4, "two", None, "str", True), (2, 16_001, 16_001, "no", None, "str", False)]))
    t = spark.createDataFrame(rows, BANDS).select("id", "bands", grid._stretches(F.col("bands")).alias("s"), grid.band_cells(F.col("bands")).alias("c")).collect()
    for x in t:
        told = sorted((col, s.value_str) for s in x.s for col in range(s.min_col, s.max_col + 1))
        assert told == sorted((c.col, c.value_str) for c in x.c)
    assert sorted((s.min_col, s.max_col) for x in t if x.id == 1000 for s in x.s) == [(1, 4), (5, 16_000)]
