"""Reports on products, and their agreement with ground truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import fold, nonempty

FILL_FIELDS = ["doc_code", "product_name", "brand", "colour", "finish"]


def _filled(c: str) -> Column:
    return nonempty(F.col(c)).isNotNull()


def fill_rates(products: DataFrame, workbooks: DataFrame, by: list[str] | None = None, fields: list[str] | None = None) -> DataFrame:
    """Share of filled values of each field, and the count; workbooks without products get zeros."""
    by, fields = by or ["workbook_id"], fields or FILL_FIELDS
    rates = products.groupBy(*by).agg(F.count("*").alias("products"), *[F.avg(_filled(f).cast("double")).alias(f"{f}_rate") for f in fields])
    return workbooks.select(*by).distinct().join(rates, by, "left").fillna(0, ["products", *[f"{f}_rate" for f in fields]])


def _codes(products: DataFrame) -> DataFrame:
    return products.select("workbook_id", nonempty(F.col("doc_code")).alias("code")).where("code is not null").distinct()


def code_overlap(truth: DataFrame, products: DataFrame, least: float = 0.7) -> DataFrame:
    """Share of the true codes that were parsed, by workbook."""
    hit = _codes(products).withColumn("hit", F.lit(1))
    both = _codes(truth).join(hit, ["workbook_id", "code"], "left").groupBy("workbook_id").agg(
        F.count("*").alias("truth_codes"),
        F.count("hit").alias("found"),
    )
    return both.withColumn("overlap", F.col("found") / F.col("truth_codes")).withColumn("passes", F.col("overlap") >= least)


def count_in_band(truth: DataFrame, products: DataFrame, low: float = 0.8, high: float = 1.2) -> DataFrame:
    n = truth.groupBy("workbook_id").agg(F.count("*").alias("expected")).join(
        products.groupBy("workbook_id").agg(F.count("*").alias("parsed")),
        "workbook_id",
        "full",
    ).fillna(0)
    return n.withColumn("in_band", F.col("parsed").between(F.floor(F.col("expected") * low), F.ceil(F.col("expected") * high)))


def by_code(products: DataFrame) -> DataFrame:
    """One product for each workbook and code: the last one."""
    order = F.struct("sheet_idx", "row_num") if "row_num" in products.columns else F.col("seq")
    rest = [c for c in products.columns if c not in ("workbook_id", "doc_code")]
    keyed = products.withColumn("code", nonempty(F.col("doc_code"))).where("code is not null")
    return keyed.groupBy("workbook_id", "code").agg(F.max_by(F.struct(*rest), order).alias("p"))


def _matched(truth: DataFrame, products: DataFrame) -> DataFrame:
    return by_code(truth).withColumnRenamed("p", "t").join(by_code(products), ["workbook_id", "code"])


def text_match_rate(truth: DataFrame, products: DataFrame, field: str, least: float = 0.7) -> DataFrame:
    """Share of common codes with equal text, blanks folded, lower case, by workbook."""
    norm = lambda c: F.coalesce(fold(c), F.lit(""))
    same = norm(F.col(f"t.{field}")) == norm(F.col(f"p.{field}"))
    return _matched(truth, products).groupBy("workbook_id").agg(
        F.count("*").alias("compared"),
        F.avg(same.cast("double")).alias("match_rate"),
    ).withColumn("passes", F.col("match_rate") >= least)


def numeric_mismatches(truth: DataFrame, products: DataFrame) -> DataFrame:
    """workbook_id, code, field, expected, parsed beyond tolerance; nulls on either side are let be."""
    limit = {"qty": F.lit(0.0), "width": F.lit(2.0), "length": F.lit(2.0), "height": F.lit(2.0)}
    checks = [F.struct(F.lit(f).alias("field"), F.col(f"t.{f}").cast("double").alias("expected"), F.col(f"p.{f}").cast("double").alias("parsed"), t.alias("limit")) for f, t in limit.items()]
    checks.append(
        F.struct(
            F.lit("rrp").alias("field"),
            F.col("t.rrp").alias("expected"),
            F.col("p.rrp").alias("parsed"),
            F.greatest(F.lit(0.5), F.abs("t.rrp") * 0.2).alias("limit"),
        ),
    )
    found = _matched(truth, products).select("workbook_id", "code", F.explode(F.array(*checks)).alias("x")).select("workbook_id", "code", "x.*")
    return found.where(F.abs(F.col("expected") - F.col("parsed")) > F.col("limit")).drop("limit")


def schedule_name_match(truth: DataFrame, names: DataFrame, cells: DataFrame) -> DataFrame:
    """workbook_id, matches: where the true name stands in the first 20 x 10 cells, is it the parsed one?

    `truth` is (workbook_id, schedule_name).
    """
    t = truth.select("workbook_id", F.trim("schedule_name").alias("expected"))
    top = cells.where("row <= 20 and col <= 10").select("workbook_id", F.lower("value_str").alias("v"))
    there = t.join(top, "workbook_id").where(F.col("v").contains(F.lower("expected"))).select("workbook_id").distinct()
    return t.join(there, "workbook_id", "left_semi").join(names, "workbook_id").select(
        "workbook_id",
        (F.trim("schedule_name") == F.col("expected")).alias("matches"),
    )


def leaked_text(products: DataFrame, phrases: list[str], fields: list[str]) -> DataFrame:
    """Products that hold one of the phrases in a text field."""
    low = F.transform(F.array(*[F.coalesce(F.lower(f), F.lit("")) for f in fields]), lambda x: x)
    return products.where(F.exists(low, lambda v: F.exists(F.lit([p.lower() for p in phrases]), lambda p: v.contains(p))))


def header_row_accuracy(truth: DataFrame, found: DataFrame, within: int = 5, least: float = 0.8) -> DataFrame:
    """Share of workbooks with a found header row close to the true one. `truth`: workbook_id, header_row."""
    hit = truth.withColumnRenamed("header_row", "expected").join(found.select("workbook_id", "header_row"), "workbook_id", "left").groupBy("workbook_id").agg(
        F.coalesce(F.bool_or(F.abs(F.col("header_row") - F.col("expected")) <= within), F.lit(False)).alias("hit"),
    )
    return hit.agg(
        F.count("*").alias("workbooks"),
        F.avg(F.col("hit").cast("double")).alias("accuracy"),
    ).withColumn("passes", F.col("accuracy") >= least)


def retention_vs_source(products: DataFrame, pairs: DataFrame, keep: float = 0.5, codes: float = 0.3, files: float = 0.5) -> DataFrame:
    """Products and codes that mutated workbooks keep. `pairs`: workbook_id, source_id. One row: shares of files that pass."""
    n = products.groupBy("workbook_id").agg(F.count("*").alias("n"))
    source = lambda df: df.withColumnRenamed("workbook_id", "source_id")
    base = pairs.join(n, "workbook_id", "left").join(source(n).withColumnRenamed("n", "n0"), "source_id", "left").fillna(0, ["n", "n0"])
    c = _codes(products)
    kept = pairs.join(source(c), "source_id").join(
        c.withColumn("hit", F.lit(1)),
        ["workbook_id", "code"],
        "left",
    ).groupBy("workbook_id").agg((F.count("hit") / F.count("*")).alias("overlap"))
    each = base.join(kept, "workbook_id", "left").select(
        (F.col("n") >= F.floor(F.col("n0") * keep)).alias("count_ok"),
        (F.coalesce("overlap", F.lit(0.0)) >= codes).alias("codes_ok"),
    )
    out = each.agg(
        F.count("*").alias("files"),
        F.avg(F.col("count_ok").cast("double")).alias("count_share"),
        F.avg(F.col("codes_ok").cast("double")).alias("code_share"),
    )
    return out.withColumn("passes", (F.col("count_share") >= files) & (F.col("code_share") >= files))


def layout_family_mix(families: DataFrame, expected: DataFrame, low: float = 0.1) -> DataFrame:
    """layout_family, files, share, thin, missing. `families`: workbook_id, layout_family; `expected`: layout_family."""
    n = families.groupBy("layout_family").agg(F.count_distinct("workbook_id").alias("files"))
    n = n.withColumn("share", F.col("files") / F.sum("files").over(W.partitionBy()))
    absent = expected.select("layout_family").distinct().join(n, "layout_family", "left_anti").select(
        "layout_family",
        F.lit(0).cast("long").alias("files"),
        F.lit(0.0).alias("share"),
    )
    return n.unionByName(absent).withColumn("thin", F.col("share") < low).withColumn("missing", F.col("files") == 0)


def duplicate_codes(products: DataFrame) -> DataFrame:
    return products.select(
        "workbook_id",
        nonempty(F.col("doc_code")).alias("code"),
    ).where("code is not null").groupBy("workbook_id", "code").agg(F.count("*").alias("n")).where("n > 1")


def parse_stats(sheets: DataFrame, schedules: DataFrame, products: DataFrame) -> DataFrame:
    """workbook_id, sheets_total, schedule_sheets, products."""
    total = sheets.groupBy("workbook_id").agg(F.count("*").alias("sheets_total"))
    found = schedules.groupBy("workbook_id").agg(F.count("*").alias("schedule_sheets"))
    made = products.groupBy("workbook_id").agg(F.count("*").alias("products"))
    return total.join(found, "workbook_id", "left").join(made, "workbook_id", "left").fillna(0)


def empty_parses(names: DataFrame, products: DataFrame) -> DataFrame:
    """Workbooks without products, without any code, or without a name."""
    n = products.groupBy("workbook_id").agg(F.count("*").alias("n"), F.count(nonempty(F.col("doc_code"))).alias("codes"))
    return names.join(n, "workbook_id", "left").where(
        (F.coalesce("codes", F.lit(0)) == 0) | nonempty(F.col("schedule_name")).isNull(),
    ).select("workbook_id")


def layout_field_presence(products: DataFrame, families: DataFrame) -> DataFrame:
    """Whether each workbook has what its layout family promises."""
    each = families.join(products, "workbook_id", "left").groupBy("workbook_id", "layout_family").agg(
        F.count_if(_filled("product_details")).alias("details"),
        F.coalesce(F.avg(_filled("product_name").cast("double")), F.lit(0.0)).alias("names"),
        F.count("qty").alias("qtys"),
    )
    ok = F.when(
        F.col("layout_family") == "finish_schedule",
        F.col("details") >= 1,
    ).when(F.col("layout_family") == "normalized", F.col("names") >= 0.5).when(F.col("layout_family") == "ffe_tracker", F.col("qtys") >= 1)
    return each.withColumn("passes", F.coalesce(ok, F.lit(True)))
