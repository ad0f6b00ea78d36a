"""Schedules derived from the order tables, for queries that are checked against SQL.

Every supplier is a workbook and every line number a sheet. The same rules in SQL form are
`BASE_SQL` (one row for each line) and, for products, each query's own statement.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators.grid import computed

SECTIONS = ["LIVING ROOM", "KITCHEN", "BEDROOM", "STUDY"]
COLOURS = ["Charcoal", "Ivory", "Sage", "Walnut", "Slate"]
UNITS = ["MM", "CM", "M", "MM", "CM"]
FACTORS = [1, 10, 1000, 1, 10]
HEADERS = [
    ["SPEC CODE", "Item & Location", "Specifications", "Manufacturer", "Notes", "Qty", "Cost per unit $"],
    ["Code:", "Room", "Specs (see notes)", "Supplier details", "Comments", "Quantity", "RRP"],
    ["Product Code", "Location", "Specification", "Manufaturer", "Remarks.", "QTY", "Unit  Cost"],
]
HEADER_ROW, PER_SECTION = 4, 19

BASE_SQL = """
base AS (
  SELECT l_suppkey AS sup, l_linenumber AS sh, l_partkey AS pk, CAST(l_quantity AS INT) AS q, l_returnflag AS rf, p_name, p_brand, p_type, p_size,
         row_number() OVER (PARTITION BY l_suppkey, l_linenumber ORDER BY l_orderkey, l_partkey, l_extendedprice) AS rn
  FROM lineitem JOIN part ON l_partkey = p_partkey
),
lines AS (
  SELECT *, CAST(sup AS VARCHAR) AS workbook_id, CAST(sh AS INT) AS sheet_idx, CAST(6 + (rn - 1) + CAST(floor((rn - 1) / 19) AS BIGINT) AS INT) AS row_num,
         CAST(floor((rn - 1) / 19) AS BIGINT) AS block
  FROM base
)
"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines, numbered in their sheets. Parts are packed so well on disk that millions of them would be sent to the driver: they are shuffled."""
    line, part = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "part"))
    j = line.join(part.hint("shuffle_hash"), line["l_partkey"] == part["p_partkey"])
    rn = F.row_number().over(W.partitionBy("l_suppkey", "l_linenumber").orderBy("l_orderkey", "l_partkey", "l_extendedprice")).cast("long")
    j = j.select(
        F.col("l_suppkey").alias("sup"),
        F.col("l_linenumber").alias("sh"),
        F.col("l_partkey").alias("pk"),
        F.col("l_quantity").cast("int").alias("q"),
        F.col("l_returnflag").alias("rf"),
        "p_name",
        "p_brand",
        "p_type",
        "p_size",
        rn.alias("rn"),
    )
    block = F.expr(f"(rn - 1) div {PER_SECTION}")
    return j.select(
        "*",
        F.col("sup").cast("string").alias("workbook_id"),
        F.col("sh").cast("int").alias("sheet_idx"),
        (F.lit(6) + F.col("rn") - 1 + block).cast("int").alias("row_num"),
        block.alias("block"),
    )


def texts(ln: DataFrame) -> DataFrame:
    """`lines` with the texts of their cells."""
    pk = F.col("pk")
    pick = lambda words, n: F.element_at(F.lit(words), (F.pmod(n, F.lit(len(words))) + 1).cast("int"))
    size = F.concat(F.lit("SIZE = "), (pk % 90 + 1).cast("string"), F.lit(" X "), (pk % 70 + 2).cast("string"), F.lit(" "), pick(UNITS, pk))
    specs = F.concat(
        F.lit("PRODUCT: "),
        "p_name",
        F.lit("\nCOLOUR - "),
        pick(COLOURS, pk),
        F.lit("\n"),
        size,
        F.lit("|FINISH- "),
        "p_type",
        F.lit("\nSTYLE: S"),
        (pk % 4).cast("string"),
        F.lit("\nas drawn"),
    )
    price = (pk % 900 + 10).cast("string")
    cost = F.element_at(
        F.array(
            price,
            F.concat(F.lit("$"), price, F.lit(".50+GST")),
            F.lit("TBC"),
            F.concat(price, F.lit(" PER SQM")),
            F.lit(None).cast("string"),
            F.concat(F.lit("RRP "), price),
        ),
        (pk % 6 + 1).cast("int"),
    )
    return ln.withColumns(
        {
            "doc_code": F.when(F.col("rf") != "N", F.concat(F.lit("P-"), pk.cast("string"))),
            "item_location": F.concat("p_brand", F.lit(" panel for Room "), (pk % 10).cast("string")),
            "specs": specs,
            "manufacturer": F.concat(F.lit("NAME: Maker "), (pk % 7).cast("string"), F.lit("\nPHONE: 555-"), (pk % 100).cast("string")),
            "notes": F.when(pk % 5 == 0, F.lit("price on request")),
            "cost": cost,
            "cost_kind": F.when(pk % 6 == 0, "int").otherwise("str"),
        }
    )


def schedule_cells(spark: SparkSession, sf_dir: str, ln: DataFrame | None = None) -> DataFrame:
    """The grid: title in row 1, headers in row 4, then sections of 19 product rows.

    The section's name stands in column 1 alone; in even sections a merged range spreads it. The lines
    are read once: a sheet's first line brings the title and the headers, a section's first line its name.
    A line is told as the numbers of its cells, from which texts are made last, so that rows and columns a rule leaves out cost no text.
    `ln` are the lines, where a query has them already.
    """
    own, section, title, heads = [1, 2, 3, 4, 5, 6, 7], [8], [9], [10, 11, 12, 13, 14, 15, 16]
    at, k = F.col("rn") - 1, F.col("cell")
    told = F.when(at == 0, F.lit(own + section + title + heads)).when(at % PER_SECTION == 0, F.lit(own + section)).otherwise(F.lit(own))
    t = texts((lines(spark, sf_dir) if ln is None else ln).withColumn("cell", F.explode(told)))
    row = F.when(k <= 7, F.col("row_num")).when(k == 8, F.col("row_num") - 1).when(k == 9, 1).otherwise(HEADER_ROW)
    col = F.when(k <= 7, k).when(k <= 9, 1).otherwise(k - 9)
    words = F.element_at(F.lit(HEADERS), (F.pmod("sheet_idx", F.lit(len(HEADERS))) + 1).cast("int"))
    name = F.element_at(F.lit(SECTIONS), (F.pmod("block", F.lit(len(SECTIONS))) + 1).cast("int"))
    made = [F.col(c) for c in ("doc_code", "item_location", "specs", "manufacturer", "notes")]
    made += [F.col("q").cast("string"), F.col("cost"), name, F.concat(F.lit("Supplier "), "workbook_id", F.lit(" Finish Schedule"))]
    # what an empty cell lacks, as a text would have to be made twice to be asked
    lacks = [F.col("rf").isNull() | (F.col("rf") == "N"), F.col("p_brand").isNull(), F.col("p_name").isNull() | F.col("p_type").isNull(), F.lit(False), F.col("pk") % 5 != 0, F.col("q").isNull(), F.col("pk") % 6 == 4]
    lacks += [F.lit(False), F.col("workbook_id").isNull()]
    of_cell = lambda parts, other: reduce(lambda so_far, part: so_far.when(k == part[0], part[1]), list(enumerate(parts, 1)), F).otherwise(other)
    is_number = F.col("cost_kind") == "int"
    t = computed(t.where(~of_cell(lacks, F.col("sheet_idx").isNull())), {"value_str": of_cell(made, F.get(words, k - 10))})
    return t.select(
        "workbook_id",
        "sheet_idx",
        row.alias("row"),
        col.alias("col"),
        "value_str",
        F.when(k == 6, F.col("q").cast("double")).when((k == 7) & is_number, F.col("cost").try_cast("double")).alias("value_num"),
        F.when((k == 6) | ((k == 7) & is_number), "int").otherwise("str").alias("value_kind"),
    )


def schedule_merges(spark: SparkSession, sf_dir: str, ln: DataFrame | None = None) -> DataFrame:
    """A range over columns 1 to 7 of each even section's row, told by the section's first line."""
    even = (lines(spark, sf_dir) if ln is None else ln).where((F.col("rn") - 1) % (2 * PER_SECTION) == 0)
    row = F.col("row_num") - 1
    return even.select("workbook_id", "sheet_idx", row.alias("min_row"), row.alias("max_row"), F.lit(1).alias("min_col"), F.lit(7).alias("max_col"))


def schedule_sheets(spark: SparkSession, sf_dir: str, ln: DataFrame | None = None) -> DataFrame:
    s = (lines(spark, sf_dir) if ln is None else ln).select("workbook_id", "sheet_idx").distinct()
    return s.select(
        "workbook_id",
        F.concat(F.lit("supplier_"), "workbook_id", F.lit(".xlsx")).alias("filename"),
        "sheet_idx",
        F.concat(F.lit("Sheet "), F.col("sheet_idx").cast("string"), F.lit(" ")).alias("sheet_name"),
        (F.col("sheet_idx") == 1).alias("is_active"),
    )


_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_DOC = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006/relationships"


def _pack(tabs: list[dict]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for k, tab in enumerate(tabs, 1):
            z.writestr(f"xl/worksheets/sheet{k}.xml", f'<worksheet xmlns="{_MAIN}"><sheetData>{tab["rows"]}</sheetData><mergeCells><mergeCell ref="A1:C1"/></mergeCells></worksheet>')
        names = "".join(f'<sheet name="Line {t["sheet_idx"]}" sheetId="{k}" r:id="rId{k}"/>' for k, t in enumerate(tabs, 1))
        links = "".join(f'<Relationship Id="rId{k}" Type="{_DOC}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(tabs) + 1))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{_MAIN}" xmlns:r="{_DOC}"><sheets>{names}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{_PACKAGE}">{links}</Relationships>')
    return out.getvalue()


def workbook_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """workbook_id, filename, content: each supplier's lines as a packed workbook.

    A line is a name, its quantity and twice the quantity, a formula that a sheet's lines share;
    workbooks of suppliers divisible by 10 lack their last 40 bytes.
    """
    name, row = F.replace(F.replace("p_name", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.col("row_num").cast("string")
    master = F.concat(F.lit('<f t="shared" ref="C6:C1000000" si="0">B'), row, F.lit("*2</f>"))
    parts = ['<row r="', row, '"><c t="inlineStr"><is><t>', name, "</t></is></c><c><v>", F.col("q").cast("string"), "</v></c><c>", F.when(F.col("row_num") == 6, master).otherwise('<f t="shared" si="0"/>'), "</c></row>"]
    xml = F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    in_order = F.transform(F.sort_array(F.collect_list(F.struct("row_num", xml.alias("xml")))), lambda r: r["xml"])
    tabs = lines(spark, sf_dir).groupBy("workbook_id", "sheet_idx").agg(F.array_join(in_order, "").alias("rows"))
    books = tabs.groupBy("workbook_id").agg(F.sort_array(F.collect_list(F.struct("sheet_idx", "rows"))).alias("tabs"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, packed = b.column("workbook_id"), [_pack(t) for t in b.column("tabs").to_pylist()]
            yield pa.RecordBatch.from_arrays([ids, pa.array(packed, pa.binary())], names=["workbook_id", "content"])

    made = books.mapInArrow(pack, "workbook_id string, content binary")
    cut = F.when(F.col("workbook_id").cast("long") % 10 == 0, F.substring("content", F.lit(1), F.length("content") - 40)).otherwise(F.col("content"))
    return made.select("workbook_id", F.concat("workbook_id", F.lit(".xlsx")).alias("filename"), cut.alias("content"))
