"""Tables that grow with the lines do not pass through the driver, however small they are on disk."""

from pyspark.sql import functions as F

from sheetloom.jobs import fixtures
from sheetloom.operators import grid

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_parts_are_not_broadcast(spark):
    for df in (fixtures.lines(spark, SF), fixtures.schedule_cells(spark, SF), fixtures.schedule_merges(spark, SF)):
        assert "Broadcast" not in _plan(df)


def test_few_places_are_told_before_texts_are_made(spark):
    cells = fixtures.schedule_cells(spark, SF)
    spots = spark.range(300).select(F.lit(1).alias("at_row"), F.lit(1).alias("at_col"))
    met = grid.at_places(cells, spots, "at_row", "at_col")
    plan = _plan(met)
    assert "Broadcast" not in plan
    text = next(k for k, line in enumerate(plan.splitlines()) if "Finish Schedule" in line)
    assert any("Filter" in line and "xxhash64" in line for line in plan.splitlines()[text:]), plan  # below the making of texts
    assert met.where("row = 1 and col = 1").count() == met.count() > 0
