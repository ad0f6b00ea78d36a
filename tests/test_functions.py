from pyspark.sql import functions as F

from sheetloom.functions import kv, text, units


def one(spark, make, value):
    return spark.createDataFrame([(value,)], "x string").select(make(F.col("x")).alias("r")).first()["r"]


def test_kv_block(spark):
    got = one(spark, kv.parse_kv, "NAME - BLINK\nCOLOUR - BLANCO\nFINISH- MATT\nDIMENSIONS- 600X600 MM")
    assert [(r["key"], r["value"]) for r in got] == [("NAME", "BLINK"), ("COLOUR", "BLANCO"), ("FINISH", "MATT"), ("SIZE", "600X600 MM")]
    assert one(spark, kv.parse_kv, None) == []


def test_prices(spark):
    values = ["$25 +GST PER SQM", "$1,234.56", "RRP 199.99", "TBC", None]
    rows = spark.createDataFrame(
        [(k, v) for k, v in enumerate(values)],
        "k int, x string",
    ).select("k", units.parse_price(F.col("x")).alias("r")).orderBy("k").collect()
    assert [r["r"] for r in rows] == [25.0, 1234.56, 199.99, None, None]


def test_dimensions(spark):
    values = ["1200 (W) x 800 (D) x 330 (H) mm", "SHEET SIZE MAX: 5500 X 2800 MM", "3.66 METRES", "600X600 MM"]
    rows = spark.createDataFrame(
        [(k, v) for k, v in enumerate(values)],
        "k int, x string",
    ).select("k", units.parse_dimensions(F.col("x")).alias("r")).orderBy("k").collect()
    assert [tuple(r["r"]) for r in rows] == [(1200, 800, 330), (5500, 2800, None), (3660, None, None), (600, None, 600)]


def test_header_keeps_the_blank_before_a_stop(spark):
    assert one(spark, text.norm_header, " Spec\n Code :") == "spec code "
    assert one(spark, text.norm_header_first_line, "Qty.\nmore") == "qty"
