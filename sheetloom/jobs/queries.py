"""Registered queries of the schedule library, each with its rule in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kv, text, units
from ..functions.lexicon import ECHO
from ..sources import intake
from ..sources.store import place, settle
from ..operators import columns, grid, headers, naming, products, quality, rows
from ..operators.texts import by_text
from . import fixtures
from .fixtures import BASE_SQL
from .schedules import parse_products

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = "WITH " + BASE_SQL.strip() + (
                ",\n" + sql.strip() if not sql.strip().upper().startswith("SELECT") else "\n" + sql.strip()
            )
        return f

    return register


# Expressions of the rules, in SQL
_COLOUR = "CASE pk % 5 WHEN 0 THEN 'Charcoal' WHEN 1 THEN 'Ivory' WHEN 2 THEN 'Sage' WHEN 3 THEN 'Walnut' ELSE 'Slate' END"
_FACTOR = "CASE pk % 5 WHEN 0 THEN 1 WHEN 1 THEN 10 WHEN 2 THEN 1000 WHEN 3 THEN 1 ELSE 10 END"
_WIDTH = f"CAST((pk % 90 + 1) * {_FACTOR} AS INT)"
_OTHER = f"CAST((pk % 70 + 2) * {_FACTOR} AS INT)"
_SECTION = "CASE block % 4 WHEN 0 THEN 'LIVING ROOM' WHEN 1 THEN 'KITCHEN' WHEN 2 THEN 'BEDROOM' ELSE 'STUDY' END"
_RRP = "CASE pk % 6 WHEN 0 THEN CAST(pk % 900 + 10 AS DOUBLE) WHEN 1 THEN pk % 900 + 10.5 WHEN 5 THEN CAST(pk % 900 + 10 AS DOUBLE) END"
_CODE = "CASE WHEN rf <> 'N' THEN 'P-' || CAST(pk AS VARCHAR) END"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines, joined and numbered once: what a query makes of them starts from these files, a few bytes a line."""
    return settle(fixtures.lines(spark, sf_dir))


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settle(fixtures.schedule_cells(spark, sf_dir))


def _merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settle(fixtures.schedule_merges(spark, sf_dir))


def _top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of the grid where headers are looked for and columns are read; header rows are read from the lines again, without other texts."""
    cells = fixtures.schedule_cells(spark, sf_dir)
    return cells.where((F.col("row") <= headers.SCAN_ROWS) & (F.col("col") <= columns.MAX_COLS))


@query(f"""
kept AS (SELECT *, CASE WHEN rf = 'N' THEN 1 ELSE row_number() OVER (PARTITION BY sup, rf = 'N', pk ORDER BY sh, rn) END AS nth FROM lines)
SELECT workbook_id, sheet_idx, row_num, {_CODE} AS doc_code, p_name AS product_name, 'Maker ' || CAST(pk % 7 AS VARCHAR) AS brand, {_COLOUR} AS colour, p_type AS finish,
       {_WIDTH} AS width, CASE WHEN pk % 90 + 1 <> pk % 70 + 2 THEN {_OTHER} END AS length, CASE WHEN pk % 90 + 1 = pk % 70 + 2 THEN {_OTHER} END AS height,
       q AS qty, {_RRP} AS rrp, {_SECTION} || ' | Room ' || CAST(pk % 10 AS VARCHAR) AS product_description,
       'STYLE: S' || CAST(pk % 4 AS VARCHAR) || ' | PHONE: 555-' || CAST(pk % 100 AS VARCHAR) AS product_details,
       CAST(row_number() OVER (PARTITION BY sup ORDER BY sh, rn) AS INT) AS seq
FROM kept WHERE nth = 1
""")
def parse_schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E1 with G1, H4, C1-C6, C9, R1-R3, R8, R10, R11, R13, R14, K3, N3-N7, P1-P12, D1, D2."""
    ln = _lines(spark, sf_dir)
    cells, merges = fixtures.schedule_cells(spark, sf_dir, ln), settle(fixtures.schedule_merges(spark, sf_dir, ln))
    p = parse_products(cells, merges, lying=fixtures.schedule_cells(spark, sf_dir, grid.by_sheet(ln)))
    return p.select(
        "workbook_id",
        "sheet_idx",
        "row_num",
        "doc_code",
        "product_name",
        "brand",
        "colour",
        "finish",
        "width",
        "length",
        "height",
        "qty",
        "rrp",
        "product_description",
        "product_details",
        "seq",
    )


@query("""
SELECT workbook_id, sheet_idx, 4 AS header_row, CASE sheet_idx % 3 WHEN 0 THEN 7 ELSE 6 END AS score FROM lines GROUP BY 1, 2
""")
def header_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H1-H4: the header row of every sheet."""
    h = headers.find_header_row(fixtures.schedule_cells(spark, sf_dir), merges=_merges(spark, sf_dir))
    return h.select("workbook_id", "sheet_idx", "header_row", F.size("canonicals").alias("score"))


@query("""
SELECT workbook_id, sheet_idx, c.canonical, c.col FROM (SELECT DISTINCT workbook_id, sheet_idx FROM lines), (VALUES ('doc_code', 1), ('item_location', 2), ('specs', 3), ('manufacturer', 4), ('notes', 5), ('qty', 6), ('cost', 7)) c(canonical, col)
""")
def column_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical columns of every sheet."""
    cells = _top(spark, sf_dir)
    return columns.map_columns(cells, settle(headers.find_header_row(cells))).select("workbook_id", "sheet_idx", "canonical", "col")


@query("""
SELECT match_type, SUM(n * sheets) AS headers FROM
  (SELECT sheet_idx % 3 AS k, CAST(COUNT(DISTINCT (workbook_id, sheet_idx)) AS BIGINT) AS sheets FROM lines GROUP BY 1)
  JOIN (VALUES (0, 'exact', 7), (1, 'exact', 5), (1, 'partial', 2), (2, 'exact', 6), (2, 'fuzzy', 1)) v(k, match_type, n) USING (k) GROUP BY 1
""")
def mapping_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header cells by how they were matched."""
    cells = _top(spark, sf_dir)
    a = columns.column_mapping_audit(cells, settle(headers.find_header_row(cells)))
    return a.groupBy("match_type").agg(F.count("*").cast("decimal(38,0)").alias("headers"))


@query("""
SELECT workbook_id, sheet_idx, 'Sheet ' || CAST(sheet_idx AS VARCHAR) || ' ' AS sheet_name, 4 AS header_row FROM lines GROUP BY 1, 2, 3
""")
def schedule_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H6, H7: qualifying sheets."""
    return headers.schedule_sheets(fixtures.schedule_cells(spark, sf_dir), fixtures.schedule_sheets(spark, sf_dir))


@query("""
SELECT workbook_id, sheet_idx, c.canonical, c.col FROM (SELECT DISTINCT workbook_id, sheet_idx FROM lines), (VALUES ('doc_code', 1), ('item_location', 2), ('specs', 3), ('manufacturer', 4), ('notes', 5), ('qty', 6), ('cost', 7)) c(canonical, col)
WHERE sheet_idx % 3 = 0 OR c.canonical <> 'manufacturer'
""")
def header_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H5: the first column of each name that the detector sees in a header row."""
    return headers.find_header_columns(fixtures.schedule_cells(spark, sf_dir)).drop("header_row")


@query("""
SELECT workbook_id, sheet_idx, CAST(MAX(row_num) AS INT) AS max_row, 7 AS max_col, CAST(COUNT(*) * 6 + COUNT(CASE WHEN rf <> 'N' THEN 1 END) - COUNT(CASE WHEN pk % 5 <> 0 THEN 1 END) - COUNT(CASE WHEN pk % 6 = 4 THEN 1 END)
  + 8 + (MAX(block) + 1) + 6 * (MAX(block) // 2 + 1) AS BIGINT) AS cells FROM lines GROUP BY 1, 2
""")
def merged_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filled grid's used range and its cells."""
    ln = _lines(spark, sf_dir)
    f = grid.fill_merged(fixtures.schedule_cells(spark, sf_dir, ln), settle(fixtures.schedule_merges(spark, sf_dir, ln)))
    return grid.used_range(f, F.count("*").alias("cells"))


@query(f"""
SELECT workbook_id, sheet_idx, CAST(5 + block * 20 AS INT) AS row, k AS col, CASE WHEN block % 2 = 0 OR k = 1 THEN {_SECTION} END AS value_str, block % 2 = 0 AS merged, block % 2 = 0 AND k = 1 AS topleft,
       CASE WHEN block % 2 = 0 THEN 7 END AS max_col
FROM (SELECT DISTINCT workbook_id, sheet_idx, block FROM lines), (VALUES (1), (3)) v(k)
""")
def merged_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values and ranges at two points of every section row."""
    cells, merges = fixtures.schedule_cells(spark, sf_dir), _merges(spark, sf_dir)
    first = cells.where((F.col("col") == 1) & F.col("value_str").isin(fixtures.SECTIONS)).select(*grid.SHEET, "row")
    points = settle(first.select("*", F.explode(F.lit([1, 3])).alias("col")))
    keys = [*grid.SHEET, "row", "col"]
    out = grid.merged_value(points, cells, merges).select(*keys, "value_str")
    out = out.join(grid.is_merged(points, merges).withColumn("m", F.lit(True)), keys, "left").join(
        grid.is_merged_topleft(points, merges).withColumn("t", F.lit(True)),
        keys,
        "left",
    )
    out = out.join(grid.merged_range_of(points, merges).select(*keys, "max_col"), keys)
    return out.select(*keys, "value_str", F.coalesce("m", F.lit(False)).alias("merged"), F.coalesce("t", F.lit(False)).alias("topleft"), "max_col")


def _far(ln: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cells, merges) beyond column 30: every line's brand in column 35, merged over up to 40 columns, and a section's name in column 80, merged over 19 rows and two columns."""
    cell = lambda row, col, text: [row.cast("int").alias("row"), F.lit(col).alias("col"), text.alias("value_str"), F.lit(None).cast("double").alias("value_num"), F.lit("str").alias("value_kind")]
    area = lambda *ends: [x.cast("int").alias(n) for n, x in zip(("min_row", "max_row", "min_col", "max_col"), ends, strict=True)]
    row, lit = F.col("row_num"), F.lit
    blocks = ln.where((F.col("rn") - 1) % fixtures.PER_SECTION == 0).select(*grid.SHEET, "block").withColumn("row", lit(6) + 20 * F.col("block"))
    name = F.element_at(F.lit(fixtures.SECTIONS), (F.col("block") % 4 + 1).cast("int"))
    cells = ln.select(*grid.SHEET, *cell(row, 35, F.col("p_brand"))).unionByName(blocks.select(*grid.SHEET, *cell(F.col("row"), 80, name)))
    wide = ln.select(*grid.SHEET, *area(row, row, lit(35), lit(35) + F.col("pk") % 40))
    tall = blocks.select(*grid.SHEET, *area(F.col("row"), F.col("row") + 18, lit(80), lit(81)))
    return cells, wide.unionByName(tall)


@query(f"""
wide AS (SELECT workbook_id, sheet_idx, SUM(pk % 40 + 1) AS cells, SUM(35 * (pk % 40 + 1) + (pk % 40) * (pk % 40 + 1) // 2) AS cols, SUM(row_num * (pk % 40 + 1)) AS rows, COUNT(*) AS texts FROM lines GROUP BY 1, 2),
tall AS (SELECT workbook_id, sheet_idx, COUNT(*) * 38 AS cells, COUNT(*) * 19 * 161 AS cols, SUM(2 * (19 * (6 + 20 * block) + 171)) AS rows FROM (SELECT DISTINCT workbook_id, sheet_idx, block FROM lines) GROUP BY 1, 2)
SELECT workbook_id, sheet_idx, CAST(w.cells + t.cells AS BIGINT) AS cells, CAST(w.cols + t.cols AS BIGINT) AS col_sum, CAST(w.rows + t.rows AS BIGINT) AS row_sum FROM wide w JOIN tall t USING (workbook_id, sheet_idx)
""")
def far_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1 beyond the columns that rules read, over rows and columns."""
    filled = grid.fill_merged(*(settle(df) for df in _far(_lines(spark, sf_dir))))
    return filled.groupBy(*grid.SHEET).agg(F.count("*").alias("cells"), F.sum("col").alias("col_sum"), F.sum("row").alias("row_sum"))


@query(f"""
SELECT workbook_id, sheet_idx, row_num AS row, c.col, CASE WHEN c.col = 81 THEN {_SECTION} WHEN c.col - 35 <= pk % 40 THEN p_brand END AS value_str,
       CASE WHEN c.col = 81 THEN CAST(6 + 20 * block AS INT) WHEN c.col - 35 <= pk % 40 THEN row_num END AS min_row, CASE WHEN c.col = 81 THEN 81 WHEN c.col - 35 <= pk % 40 THEN CAST(35 + pk % 40 AS INT) END AS max_col
FROM lines, (VALUES (35), (50), (81)) c(col)
""")
def far_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges and values at three points of every line, among as many ranges."""
    ln = _lines(spark, sf_dir)
    points = ln.select(*grid.SHEET, F.col("row_num").alias("row"), F.explode(F.lit([35, 50, 81])).alias("col"))
    return grid.points_seen(points, *_far(ln)).select(*grid.SHEET, "row", "col", "value_str", "min_row", "max_col")


#: All lines in one sheet: nine rows for each order, and a section over 4096 orders.
_LONG_SQL = """
long AS (SELECT l_orderkey AS ok, l_linenumber AS ln, MIN(l_partkey) AS pk, MIN(CAST(l_quantity AS INT)) AS q, CAST(11 + l_orderkey * 9 + l_linenumber AS INT) AS row_num FROM lineitem GROUP BY 1, 2)
"""


def _long_cells(spark: SparkSession, sf_dir: str, grouped: bool) -> DataFrame:
    """Cells of that sheet. Grouped: an order is an item, its lines are details."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("pk"), F.min(F.col("l_quantity").cast("int")).alias("q"))
    order = F.col("l_orderkey")
    cell = lambda k, v, n=None: F.struct(F.lit(k).alias("col"), v.cast("string").alias("value_str"), (n if n is not None else F.lit(None)).cast("double").alias("value_num"), F.lit("str" if n is None else "int").alias("value_kind"))
    put = lambda df, row, *cells: df.select(F.lit("long").alias("workbook_id"), F.lit(0).alias("sheet_idx"), row.cast("int").alias("row"), F.explode(F.array(*cells)).alias("c")).select(*grid.SHEET, "row", "c.*")
    at = F.lit(11) + order * 9 + F.col("l_linenumber")
    blocks = line.select(F.floor(order / 4096).alias("block")).distinct()
    name = F.element_at(F.lit(fixtures.SECTIONS), (F.col("block") % 4 + 1).cast("int"))
    # a section's row is one before its first order
    sections = put(blocks, F.lit(10) + F.col("block") * (4096 * 9), cell(1, name))
    top = spark.range(1).select(F.lit("long").alias("workbook_id"), F.lit(0).alias("sheet_idx"), F.lit(4).alias("row"), F.posexplode(F.lit(["Code", "Image", "Location", "Label", "Details", "Qty"])).alias("k", "v"))
    top = top.select(*grid.SHEET, "row", (F.col("k") + 1).alias("col"), F.col("v").alias("value_str"), F.lit(None).cast("double").alias("value_num"), F.lit("str").alias("value_kind"))
    if grouped:
        items = put(line.select("l_orderkey").distinct(), F.lit(11) + order * 9, cell(4, F.lit("Item:")), cell(5, F.concat(F.lit("Order "), order.cast("string"))))
        body = items.unionByName(put(line, at, cell(4, F.lit("Maker:")), cell(5, F.concat(F.lit("M"), F.col("pk").cast("string")))))
    else:
        body = put(line, at, cell(1, F.concat(F.lit("P-"), F.col("pk").cast("string"))), cell(3, F.concat(F.lit("Room "), F.col("l_linenumber").cast("string"))), cell(6, F.col("q"), F.col("q")))
    return settle(body.unionByName(sections).unionByName(top))


def _long_rows(spark: SparkSession, sf_dir: str, grouped: bool) -> DataFrame:
    cells = _long_cells(spark, sf_dir, grouped)
    h = settle(headers.find_header_row(cells))
    return rows.product_rows(cells, h, columns.map_columns(cells, h))


@query(f"""
{_LONG_SQL.strip()}
SELECT CASE (ok // 4096) % 4 WHEN 0 THEN 'LIVING ROOM' WHEN 1 THEN 'KITCHEN' WHEN 2 THEN 'BEDROOM' ELSE 'STUDY' END AS section, CAST(COUNT(*) AS BIGINT) AS product_rows, CAST(SUM(row_num) AS BIGINT) AS row_sum, CAST(SUM(q) AS BIGINT) AS qty FROM long GROUP BY 1
""")
def long_sheet_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R10, R11 on one sheet that holds every line: sections are carried over many runs of rows."""
    p = _long_rows(spark, sf_dir, grouped=False)
    return p.groupBy("section").agg(F.count("*").alias("product_rows"), F.sum("row_num").alias("row_sum"), F.sum("qty.value_num").cast("long").alias("qty"))


@query(f"""
{_LONG_SQL.strip()}
SELECT CAST(11 + ok * 9 AS INT) AS row_num, CASE (ok // 4096) % 4 WHEN 0 THEN 'LIVING ROOM' WHEN 1 THEN 'KITCHEN' WHEN 2 THEN 'BEDROOM' ELSE 'STUDY' END AS section, 'Order ' || CAST(ok AS VARCHAR) AS item_name,
       string_agg('M' || CAST(pk AS VARCHAR), '|' ORDER BY ln) AS makers FROM long GROUP BY ok
""")
def long_sheet_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R10, R12 on one sheet that holds every line, as details of its orders."""
    p = _long_rows(spark, sf_dir, grouped=True)
    return p.select("row_num", "section", "item_name", F.array_join(F.transform("detail_rows", lambda d: d["value"]), "|").alias("makers"))


def _read(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """(cells, merges, headers, columns, cells that lie by sheet) of the grid; merged ranges are filled where rows are built, cells are not written."""
    ln = _lines(spark, sf_dir)
    cells, merges = fixtures.schedule_cells(spark, sf_dir, ln), settle(fixtures.schedule_merges(spark, sf_dir, ln))
    h = settle(headers.find_header_row(cells, merges=merges))
    mapped = settle(columns.map_columns(cells, h, merges=merges))
    return cells, merges, h, mapped, fixtures.schedule_cells(spark, sf_dir, grid.by_sheet(ln))


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the rules say of every row, without its cells."""
    cells, merges, h, mapped, lying = _read(spark, sf_dir)
    return settle(rows.judged(rows.classified(rows.wide_rows(cells, h, mapped, merges=merges, lying=lying)), []))


@query("""
SELECT workbook_id, sheet_idx, CAST(COUNT(*) AS BIGINT) AS product_rows, CAST(COUNT(DISTINCT block) AS BIGINT) AS sections, CAST(COUNT(CASE WHEN rf <> 'N' THEN 1 END) AS BIGINT) AS items, 'single' AS layout FROM lines GROUP BY 1, 2
""")
def row_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by kind, and the layout, of every sheet."""
    w = _judged(spark, sf_dir)
    n = w.groupBy(*grid.SHEET).agg(
        F.count_if(F.col("kind") != "section").alias("product_rows"),
        F.count_if(F.col("kind") == "section").alias("sections"),
        F.count_if(F.col("kind") == "item").alias("items"),
    )
    return n.join(rows.detect_layout(w), grid.SHEET)


@query(f"""
SELECT {_SECTION} AS section, CAST(COUNT(*) AS BIGINT) AS product_rows, CAST(SUM(row_num) AS BIGINT) AS row_sum FROM lines GROUP BY 1
""")
def section_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product rows by the section above them."""
    r = rows.single_rows(rows.fill_section(_judged(spark, sf_dir)))
    return r.groupBy("section").agg(F.count("*").alias("product_rows"), F.sum("row_num").alias("row_sum"))


@query("""
SELECT workbook_id, sheet_idx, CAST(COUNT(*) AS BIGINT) AS products FROM lines WHERE row_num <= 24 GROUP BY 1, 2
""")
def product_counts_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products in the first 20 rows below the header."""
    cells, merges, h, mapped, lying = _read(spark, sf_dir)
    return rows.product_counts(rows.product_rows(cells, h, mapped, max_rows=20, merges=merges, keep=[], lying=lying))


@query(f"""
SELECT workbook_id, sheet_idx, row_num, {_SECTION} AS section FROM lines
""")
def all_product_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every product row of every sheet."""
    cells, merges, h, mapped, lying = _read(spark, sf_dir)
    return rows.extract_all(cells, h, mapped, merges=merges, keep=[], lying=lying).select(*grid.SHEET, "row_num", "section")


GROUPED_SQL = """
g AS (SELECT *, (rn - 1) % 4 AS part, (rn - 1) // 4 AS grp FROM lines)
SELECT workbook_id, sheet_idx, CAST(MIN(rn) + 4 AS INT) AS row_num, 'Item ' || CAST(MIN(CASE WHEN part = 0 THEN pk END) AS VARCHAR) AS item_name,
       string_agg(CASE part WHEN 1 THEN 'maker=M' WHEN 2 THEN 'finish=M' ELSE 'width=M' END || CAST(pk AS VARCHAR), '|' ORDER BY rn) FILTER (WHERE part > 0) AS details, MIN(CASE WHEN part = 0 THEN q END) AS qty
FROM g GROUP BY workbook_id, sheet_idx, grp
"""


def _grouped_cells(ln: DataFrame) -> DataFrame:
    """Sheets with four rows to an item: the item, and three details below it."""
    ln = ln.withColumn("part", (F.col("rn") - 1) % 4).withColumn("row", (F.col("rn") + 4).cast("int"))
    key = F.element_at(F.lit(["Item:", "Maker:", "Finish:", "Width:"]), (F.col("part") + 1).cast("int"))
    value = F.concat(F.when(F.col("part") == 0, "Item ").otherwise("M"), F.col("pk").cast("string"))
    cell = lambda k, v, n=None: F.struct(F.lit(k).alias("col"), v.alias("value_str"), (n if n is not None else F.lit(None)).cast("double").alias("value_num"), F.lit("str" if n is None else "int").alias("value_kind"))
    qty = F.when(F.col("part") == 0, F.col("q"))
    cells = ln.select(
        *grid.SHEET,
        "row",
        F.explode(F.array(cell(4, key), cell(5, value), cell(6, qty.cast("string"), qty))).alias("c"),
    ).select(*grid.SHEET, "row", "c.*").where("value_str is not null")
    sheets = ln.where("rn = 1").select(*grid.SHEET)
    heads = ["Code", "Image", "Location", "Label", "Details", "Qty"]
    top = sheets.select(*grid.SHEET, F.lit(4).alias("row"), F.posexplode(F.lit(heads)).alias("k", "v")).select(
        *grid.SHEET,
        "row",
        (F.col("k") + 1).alias("col"),
        F.col("v").alias("value_str"),
        F.lit(None).cast("double").alias("value_num"),
        F.lit("str").alias("value_kind"),
    )
    return cells.unionByName(top)


@query(GROUPED_SQL)
def grouped_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with the detail rows below them, four sheet rows to an item."""
    cells = settle(_grouped_cells(fixtures.lines(spark, sf_dir)))
    h = settle(headers.find_header_row(cells))
    p = rows.product_rows(cells, h, columns.map_columns(cells, h))
    told = F.array_join(F.transform("detail_rows", lambda d: F.concat(d["key"], F.lit("="), d["value"])), "|")
    return p.select(
        *grid.SHEET,
        "row_num",
        "item_name",
        F.nullif(told, F.lit("")).alias("details"),
        F.col("qty")["value_num"].cast("int").alias("qty"),
    )


@query("""
g AS (SELECT *, (rn - 1) % 4 AS part, (rn - 1) // 4 AS grp FROM lines)
SELECT workbook_id, sheet_idx, row_num, 'Item ' || CAST(item AS VARCHAR) AS product_name, 'M' || CAST(maker AS VARCHAR) AS brand, 'M' || CAST(fin AS VARCHAR) AS finish, 'WIDTH: M' || CAST(wide AS VARCHAR) AS product_details, qty,
       CAST(row_number() OVER (PARTITION BY workbook_id ORDER BY sheet_idx, row_num) AS INT) AS seq
FROM (SELECT workbook_id, sheet_idx, CAST(MIN(rn) + 4 AS INT) AS row_num, MIN(CASE WHEN part = 0 THEN pk END) AS item, MIN(CASE WHEN part = 1 THEN pk END) AS maker, MIN(CASE WHEN part = 2 THEN pk END) AS fin, MIN(CASE WHEN part = 3 THEN pk END) AS wide, MIN(CASE WHEN part = 0 THEN q END) AS qty FROM g GROUP BY workbook_id, sheet_idx, grp)
""")
def grouped_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E1 on the grouped layout, with K10: details below an item become its fields."""
    ln = _lines(spark, sf_dir)
    beside = settle(fixtures.schedule_merges(spark, sf_dir, ln).withColumns({"min_col": F.lit(41), "max_col": F.lit(47)}))  # merged ranges that no rule reads
    return parse_products(_grouped_cells(ln), beside, lying=_grouped_cells(grid.by_sheet(ln))).select(*grid.SHEET, "row_num", "product_name", "brand", "finish", "product_details", "qty", "seq")


@query(f"""
SELECT workbook_id, sheet_idx, row_num, 'PRODUCT: ' || p_name || ' | COLOUR: ' || {_COLOUR} || ' | SIZE: ' || CAST(pk % 90 + 1 AS VARCHAR) || ' X ' || CAST(pk % 70 + 2 AS VARCHAR) || ' ' || CASE pk % 5 WHEN 1 THEN 'CM' WHEN 2 THEN 'M' WHEN 4 THEN 'CM' ELSE 'MM' END
       || ' | FINISH: ' || p_type || ' | STYLE: S' || CAST(pk % 4 AS VARCHAR) AS pairs,
       p_type AS finish, 5 AS n_pairs, 'as drawn' AS plain, 'Maker ' || CAST(pk % 7 AS VARCHAR) AS merged_name, 4 AS n_multi
FROM lines
""")
def kv_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1-K9: pairs of text blocks."""
    t = fixtures.texts(fixtures.lines(spark, sf_dir)).select(*grid.SHEET, "row_num", "specs", "manufacturer")

    def specs(found: DataFrame) -> DataFrame:
        of = grid.computed(found, {"kv": kv.parse_kv(F.col("text")), "lines": kv.line_pairs(F.col("text"))})
        told = {"pairs": kv.format_kv(F.col("kv")), "plain": F.array_join(kv.plain_of(F.col("lines")), "/"), "n_multi": F.size(kv.multi_of(F.col("lines")))}
        return of.withColumns(told).drop("lines")

    def makers(found: DataFrame) -> DataFrame:
        return grid.computed(found, {"kv": kv.parse_kv(F.col("text"))})

    t = by_text(settle(t), {"s": ("specs", specs), "m": ("manufacturer", makers)}, [*grid.SHEET, "row_num"])
    return t.where(F.size("s.kv") > 0).select(
        *grid.SHEET,
        "row_num",
        "s.pairs",
        kv.kv_get(F.col("s.kv"), "SURFACE", "FINISH").alias("finish"),
        F.size("s.kv").alias("n_pairs"),
        "s.plain",
        kv.kv_get(kv.merge_kv(F.col("s.kv"), F.col("m.kv")), "NAME").alias("merged_name"),
        "s.n_multi",
    )


@query(f"""
SELECT workbook_id, sheet_idx, row_num, {_WIDTH} AS mm, {_WIDTH} AS width, CASE WHEN pk % 90 + 1 <> pk % 70 + 2 THEN {_OTHER} END AS length, CASE WHEN pk % 90 + 1 = pk % 70 + 2 THEN {_OTHER} END AS height,
       CAST(pk % 70 + 2 AS INT) AS named_height, CAST(pk % 90 + 1 AS INT) AS labelled_width, {_RRP.replace("WHEN 0 THEN CAST(pk % 900 + 10 AS DOUBLE) ", "")} AS price, q AS qty, CASE pk % 6 WHEN 0 THEN CAST(pk % 900 + 10 AS DOUBLE) END AS number_price
FROM lines
""")
def unit_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths, prices and quantities from text; each different text is parsed once."""
    t = fixtures.texts(fixtures.lines(spark, sf_dir))
    a, b = (F.col("pk") % 90 + 1).cast("string"), (F.col("pk") % 70 + 2).cast("string")
    unit = F.element_at(F.lit(fixtures.UNITS), (F.col("pk") % 5 + 1).cast("int"))
    asked = settle(
        t.select(
            *grid.SHEET,
            "row_num",
            F.concat(a, F.lower(unit)).alias("mm_text"),
            F.concat(a, F.lit(" X "), b, F.lit(" "), unit).alias("size_text"),
            F.concat(F.lit("HEIGHT: "), b, F.lit(" mm\nSIZE: "), a, F.lit(" (W) x 9 (D) x 7 (H) mm")).alias("named_text"),
            F.concat(F.col("q").cast("string"), F.lit(" pcs")).alias("qty_text"),
            "cost",
        ),
    )
    none, text = F.lit(None).cast("double"), F.col("text")
    parsed = lambda **told: lambda found: grid.computed(found, told)
    rules = {
        "d": ("size_text", parsed(d=units.parse_dimensions(text))),
        "named": ("named_text", parsed(d=units.parse_dimensions(text))),
        "m": ("mm_text", parsed(mm=units.parse_mm(text))),
        "c": ("cost", parsed(price=units.parse_price(text), number_price=units.parse_numeric_price(text, none, F.lit("str")))),
        "n": ("qty_text", parsed(qty=units.parse_qty(text, none, F.lit("str")))),
    }
    return by_text(asked, rules, [*grid.SHEET, "row_num"]).select(
        *grid.SHEET, "row_num", "m.mm", "d.d.width", "d.d.length", "d.d.height", F.col("named.d.height").alias("named_height"), F.col("named.d.width").alias("labelled_width"),
        "c.price", "n.qty", "c.number_price",
    )


@query("""
SELECT workbook_id, 'Supplier ' || workbook_id || ' Finish Schedule' AS schedule_name FROM lines WHERE sheet_idx = 1 GROUP BY 1
UNION ALL SELECT workbook_id, 'supplier ' || workbook_id FROM lines GROUP BY 1 HAVING MIN(sheet_idx) > 1
""")
def schedule_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of all workbooks."""
    return naming.schedule_name(fixtures.schedule_cells(spark, sf_dir), fixtures.schedule_sheets(spark, sf_dir))


@query("""
marked AS (SELECT *, MIN(sh) OVER (PARTITION BY sup) AS first_sheet FROM lines)
SELECT workbook_id, sheet_idx, row_num AS row, 9 AS col, 'Supplier ' || workbook_id || ' Finish Schedule' AS target FROM marked WHERE first_sheet = 1
""")
def cell_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4: beside every line, in a column of its own, a reference to the title of the first sheet."""
    ln = _lines(spark, sf_dir)
    refs = ln.select(
        *grid.SHEET,
        F.col("row_num").alias("row"),
        F.lit(9).alias("col"),
        F.lit("='[1]sheet 1'!$A$1").alias("value_str"),
        F.lit(None).cast("double").alias("value_num"),
        F.lit("str").alias("value_kind"),
    )
    cells = fixtures.schedule_cells(spark, sf_dir, ln).unionByName(refs)
    return naming.resolve_cell_refs(cells, settle(fixtures.schedule_sheets(spark, sf_dir, ln)))


def _products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products as the rules have them, by columns alone: the other side of the reports."""
    t = fixtures.texts(fixtures.lines(spark, sf_dir))
    return t.select(
        *grid.SHEET,
        "row_num",
        "pk",
        "doc_code",
        F.col("p_name").alias("product_name"),
        F.when(F.col("pk") % 4 != 0, F.col("p_brand")).alias("brand"),
        F.when(F.col("pk") % 3 != 0, F.lit("Ivory")).alias("colour"),
        F.lit(" ").alias("finish"),
        F.col("q").alias("qty"),
        F.col("p_size").alias("width"),
        F.lit(None).cast("int").alias("length"),
        F.lit(None).cast("int").alias("height"),
        F.col("q").cast("double").alias("rrp"),
    )


@query("""
SELECT workbook_id, CAST(COUNT(*) AS BIGINT) AS products, AVG(CASE WHEN rf <> 'N' THEN 1.0 ELSE 0 END) AS doc_code_rate, 1.0::DOUBLE AS product_name_rate, AVG(CASE WHEN pk % 4 <> 0 THEN 1.0 ELSE 0 END) AS brand_rate, AVG(CASE WHEN pk % 3 <> 0 THEN 1.0 ELSE 0 END) AS colour_rate, 0.0::DOUBLE AS finish_rate FROM lines GROUP BY 1
""")
def fill_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q1."""
    p = _products(spark, sf_dir)
    return quality.fill_rates(p, p)


@query("""
c AS (SELECT DISTINCT workbook_id, pk FROM lines WHERE rf <> 'N')
SELECT workbook_id, CAST(COUNT(*) AS BIGINT) AS truth_codes, CAST(COUNT(CASE WHEN pk % 3 <> 0 THEN 1 END) AS BIGINT) AS found, COUNT(CASE WHEN pk % 3 <> 0 THEN 1 END) / COUNT(*) AS overlap, COUNT(CASE WHEN pk % 3 <> 0 THEN 1 END) / COUNT(*) >= 0.7 AS passes FROM c GROUP BY 1
""")
def code_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q2: a third of the codes are read wrongly."""
    p = _products(spark, sf_dir)
    wrong = F.when(F.col("pk") % 3 == 0, F.concat(F.lit("misread "), F.col("doc_code"))).otherwise(F.col("doc_code"))
    return quality.code_overlap(p, p.withColumn("doc_code", wrong))


@query("""
SELECT workbook_id, CAST(COUNT(*) AS BIGINT) AS expected, CAST(COUNT(*) + COUNT(CASE WHEN pk % 5 = 0 THEN 1 END) AS BIGINT) AS parsed, COUNT(*) + COUNT(CASE WHEN pk % 5 = 0 THEN 1 END) BETWEEN floor(COUNT(*) * 0.8::DOUBLE) AND ceil(COUNT(*) * 1.2::DOUBLE) AS in_band FROM lines GROUP BY 1
""")
def count_in_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q3: a fifth of the products are read twice."""
    p = _products(spark, sf_dir)
    twice = p.withColumn("time", F.explode(F.when(F.col("pk") % 5 == 0, F.lit([1, 2])).otherwise(F.lit([1])))).drop("time")
    return quality.count_in_band(p, twice)


@query("""
c AS (SELECT DISTINCT workbook_id, pk FROM lines WHERE rf <> 'N')
SELECT workbook_id, CAST(COUNT(*) AS BIGINT) AS compared, AVG(CASE WHEN pk % 4 <> 1 THEN 1.0 ELSE 0 END) AS match_rate, AVG(CASE WHEN pk % 4 <> 1 THEN 1.0 ELSE 0 END) >= 0.7 AS passes FROM c GROUP BY 1
""")
def text_match_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q4: names in capitals and with wide blanks match, changed ones do not."""
    p = _products(spark, sf_dir)
    other = p.withColumn(
        "product_name",
        F.when(F.col("pk") % 4 == 1, F.concat("product_name", F.lit(" x"))).otherwise(F.upper(F.replace("product_name", F.lit(" "), F.lit("  ")))),
    )
    return quality.text_match_rate(p, other, "product_name")


@query("""
last AS (SELECT workbook_id, pk, arg_max(q, (sheet_idx, row_num)) AS q, arg_max(p_size, (sheet_idx, row_num)) AS w FROM lines WHERE rf <> 'N' GROUP BY 1, 2),
m AS (SELECT workbook_id, 'P-' || CAST(pk AS VARCHAR) AS code, pk, q, w FROM last)
SELECT workbook_id, code, 'qty' AS field, CAST(q AS DOUBLE) AS expected, CAST(q + 1 AS DOUBLE) AS parsed FROM m WHERE pk % 2 = 0
UNION ALL SELECT workbook_id, code, 'width', CAST(w AS DOUBLE), CAST(w + pk % 4 AS DOUBLE) FROM m WHERE pk % 4 = 3
UNION ALL SELECT workbook_id, code, 'rrp', CAST(q AS DOUBLE), q + 3.0::DOUBLE FROM m WHERE 3.0 > greatest(0.5, q * 0.2::DOUBLE)
""")
def numeric_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q5."""
    p = _products(spark, sf_dir)
    other = p.withColumns(
        {
            "qty": F.when(F.col("pk") % 2 == 0, F.col("qty") + 1).otherwise(F.col("qty")),
            "width": F.col("width") + (F.col("pk") % 4).cast("int"),
            "rrp": F.col("rrp") + 3,
        },
    )
    return quality.numeric_mismatches(p, other)


@query("""
SELECT workbook_id, CAST(workbook_id AS BIGINT) % 2 = 0 AS matches FROM lines GROUP BY 1
""")
def schedule_name_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q6: true names that stand in the grid against names of which every other one is wrong."""
    cells = _cells(spark, sf_dir)
    truth = cells.select("workbook_id").distinct().withColumn(
        "schedule_name",
        F.concat(F.lit(" Supplier "), "workbook_id", F.lit(" Finish Schedule")),
    )
    names = truth.withColumn("schedule_name", F.when(F.col("workbook_id").cast("long") % 2 == 0, F.col("schedule_name")).otherwise("other"))
    return quality.schedule_name_match(truth, names, cells)


@query("""
SELECT workbook_id, sheet_idx, row_num, -q AS qty FROM lines WHERE pk % 11 = 0 AND q > 0
""")
def negative_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products of which every eleventh part has its quantity negated."""
    p = _products(spark, sf_dir).withColumn("qty", F.when(F.col("pk") % 11 == 0, -F.col("qty")).otherwise(F.col("qty")))
    return products.negative_products(p).select(*grid.SHEET, "row_num", "qty")


@query("""
SELECT workbook_id, 'Supplier ' || workbook_id || ' Finish Schedule' AS cover FROM lines WHERE sheet_idx = 2 GROUP BY 1
""")
def cover_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5: names from the second sheet, which is called a cover."""
    sheets = fixtures.schedule_sheets(spark, sf_dir)
    sheets = sheets.withColumn("sheet_name", F.when(F.col("sheet_idx") == 2, " Front COVER").otherwise(F.col("sheet_name")))
    return naming.cover_sheet_name(_cells(spark, sf_dir), sheets)


@query("""
SELECT workbook_id, CAST(COUNT(*) AS BIGINT) AS leaks FROM lines WHERE p_name LIKE '%red%' OR p_name LIKE '%ring%' GROUP BY 1
""")
def leaked_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q7."""
    return quality.leaked_text(_products(spark, sf_dir), ["RED", "ring"], ["product_name"]).groupBy("workbook_id").agg(F.count("*").alias("leaks"))


@query("""
w AS (SELECT DISTINCT workbook_id, CAST(workbook_id AS BIGINT) AS k FROM lines)
SELECT CAST(COUNT(*) AS BIGINT) AS workbooks, AVG(CASE WHEN k % 10 < 8 THEN 1.0 ELSE 0 END) AS accuracy, AVG(CASE WHEN k % 10 < 8 THEN 1.0 ELSE 0 END) >= 0.8 AS passes FROM w
""")
def header_row_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q8: detected header rows against true rows, two of ten of them far off."""
    cells = _cells(spark, sf_dir)
    truth = cells.select("workbook_id").distinct().withColumn("header_row", F.when(F.col("workbook_id").cast("long") % 10 < 8, 9).otherwise(10))
    return quality.header_row_accuracy(truth, headers.find_header_row(cells))


@query("""
n AS (SELECT workbook_id, COUNT(*) AS n0, COUNT(CASE WHEN pk % 2 = 0 THEN 1 END) AS n FROM lines GROUP BY 1),
c AS (SELECT workbook_id, COUNT(*) AS c0, COUNT(CASE WHEN has THEN 1 END) AS c FROM (SELECT workbook_id, pk, pk % 2 = 0 AS has FROM lines WHERE rf <> 'N' GROUP BY 1, 2, 3) GROUP BY 1),
e AS (SELECT n >= floor(n0 * 0.5::DOUBLE) AS a, coalesce(c / c0, 0) >= 0.3 AS b FROM n LEFT JOIN c USING (workbook_id))
SELECT CAST(COUNT(*) AS BIGINT) AS files, AVG(CASE WHEN a THEN 1.0 ELSE 0 END) AS count_share, AVG(CASE WHEN b THEN 1.0 ELSE 0 END) AS code_share, AVG(CASE WHEN a THEN 1.0 ELSE 0 END) >= 0.5 AND AVG(CASE WHEN b THEN 1.0 ELSE 0 END) >= 0.5 AS passes FROM e
""")
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q9: each workbook against a twin whose rows of every other part went to a second twin."""
    p = _products(spark, sf_dir)
    twin = p.withColumn("workbook_id", F.concat(F.when(F.col("pk") % 2 == 0, "m").otherwise("n"), "workbook_id"))
    pairs = p.select(F.col("workbook_id").alias("source_id")).distinct().withColumn("workbook_id", F.concat(F.lit("m"), "source_id"))
    return quality.retention_vs_source(p.unionByName(twin), pairs)


@query("""
f AS (SELECT DISTINCT workbook_id, CASE WHEN CAST(workbook_id AS BIGINT) % 20 = 0 THEN 'normalized' ELSE 'finish_schedule' END AS layout_family FROM lines),
n AS (SELECT layout_family, CAST(COUNT(*) AS BIGINT) AS files FROM f GROUP BY 1)
SELECT layout_family, files, files / SUM(files) OVER () AS share, files / SUM(files) OVER () < 0.1 AS thin, false AS missing FROM n UNION ALL SELECT 'ffe_tracker', 0, 0, true, true
""")
def layout_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q10."""
    f = fixtures.lines(spark, sf_dir).select(
        "workbook_id",
        F.when(F.col("sup") % 20 == 0, "normalized").otherwise("finish_schedule").alias("layout_family"),
    )
    return quality.layout_family_mix(f, spark.createDataFrame([("finish_schedule",), ("normalized",), ("ffe_tracker",)], "layout_family string"))


@query(f"""
SELECT workbook_id, {_CODE} AS code, CAST(COUNT(*) AS BIGINT) AS n FROM lines WHERE rf <> 'N' GROUP BY 1, 2 HAVING COUNT(*) > 1
""")
def duplicate_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q11."""
    return quality.duplicate_codes(_products(spark, sf_dir))


@query("""
SELECT workbook_id, CAST(COUNT(DISTINCT sheet_idx) AS BIGINT) AS sheets_total, CAST(COUNT(DISTINCT sheet_idx) AS BIGINT) AS schedule_sheets, CAST(COUNT(*) AS BIGINT) AS products FROM lines GROUP BY 1
""")
def parse_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q12."""
    sheets = fixtures.schedule_sheets(spark, sf_dir)
    return quality.parse_stats(sheets, headers.schedule_sheets(fixtures.schedule_cells(spark, sf_dir), sheets), _products(spark, sf_dir))


@query("""
SELECT workbook_id FROM lines GROUP BY 1 HAVING COUNT(CASE WHEN rf <> 'N' AND pk % 50 = 0 THEN 1 END) = 0 OR CAST(workbook_id AS BIGINT) % 7 = 0
""")
def empty_parses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q13: where only every fiftieth part has a code, and every seventh name is blank."""
    p = _products(spark, sf_dir)
    names = p.select("workbook_id").distinct().withColumn("schedule_name", F.when(F.col("workbook_id").cast("long") % 7 == 0, "  ").otherwise("x"))
    return quality.empty_parses(names, p.withColumn("doc_code", F.when(F.col("pk") % 50 == 0, F.col("doc_code"))))


@query("""
f AS (SELECT workbook_id, CASE CAST(workbook_id AS BIGINT) % 3 WHEN 0 THEN 'finish_schedule' WHEN 1 THEN 'normalized' ELSE 'ffe_tracker' END AS layout_family, COUNT(CASE WHEN pk % 97 = 0 THEN 1 END) AS d, AVG(CASE WHEN pk % 2 = 0 THEN 1.0 ELSE 0 END) AS nm, COUNT(CASE WHEN pk % 89 = 0 THEN 1 END) AS qs FROM lines GROUP BY 1, 2)
SELECT workbook_id, layout_family, CAST(d AS BIGINT) AS details, nm AS names, CAST(qs AS BIGINT) AS qtys, CASE layout_family WHEN 'finish_schedule' THEN d >= 1 WHEN 'normalized' THEN nm >= 0.5 ELSE qs >= 1 END AS passes FROM f
""")
def layout_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q14."""
    p = _products(spark, sf_dir).select(
        "workbook_id",
        F.when(F.col("pk") % 97 == 0, "x").alias("product_details"),
        F.when(F.col("pk") % 2 == 0, F.col("product_name")).alias("product_name"),
        F.when(F.col("pk") % 89 == 0, F.col("qty")).alias("qty"),
    )
    k = F.col("workbook_id").cast("long") % 3
    f = p.select("workbook_id").distinct().withColumn(
        "layout_family",
        F.when(k == 0, "finish_schedule").when(k == 1, "normalized").otherwise("ffe_tracker"),
    )
    return quality.layout_field_presence(p, f)


@query(f"""
d AS (SELECT *, CASE WHEN rf = 'N' THEN 1 ELSE row_number() OVER (PARTITION BY sup, rf = 'N', pk ORDER BY sh, rn) END AS nth FROM lines)
SELECT workbook_id, {_CODE} AS doc_code, CAST(row_number() OVER (PARTITION BY sup ORDER BY sh, rn) AS INT) AS seq FROM d WHERE nth = 1
""")
def dedupe_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of each code in a workbook, and all without one."""
    p = products.ordered_products(products.dedupe_by_doc_code(_products(spark, sf_dir)))
    return p.select("workbook_id", "doc_code", "seq")


@query("""
SELECT workbook_id, sheet_idx, row_num, p_brand || ' panel' AS name_left, 'Room ' || CAST(pk % 10 AS VARCHAR) AS location, 'P' || CAST(pk AS VARCHAR) AS code, p_name AS name_right, 'img' || CAST(pk AS VARCHAR) AS image_code, 'sheets ' || p_name AS folded, p_name || ' ' AS header
FROM lines
""")
def text_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locations, codes and texts cut apart."""
    t = fixtures.texts(fixtures.lines(spark, sf_dir))
    pk = F.col("pk").cast("string")
    t = t.withColumns(
        {
            "parts": products.split_item_location(F.col("item_location")),
            "coded": products.code_in_name(F.concat(F.lit("P"), pk, F.lit(" – "), "p_name")),
        },
    )
    blank = F.lit("  \t")
    return t.select(
        *grid.SHEET,
        "row_num",
        F.col("parts.left").alias("name_left"),
        F.col("parts.right").alias("location"),
        F.col("coded.left").alias("code"),
        F.col("coded.right").alias("name_right"),
        products.code_in_image(F.concat(F.lit("a/b/img"), pk, F.lit(".PNG"))).alias("image_code"),
        text.norm_cell_text(F.concat(blank, F.lit("SHEETS "), F.upper("p_name"), blank)).alias("folded"),
        text.norm_header(F.concat(blank, F.upper("p_name"), F.lit(" :.-"))).alias("header"),
    )


@query("""
good AS (SELECT * FROM lines WHERE sup % 10 <> 0)
SELECT workbook_id, 'cell' AS record_type, 'Line ' || CAST(sh AS VARCHAR) AS sheet_name, row_num AS row, 1 AS col, p_name AS value_str, CAST(NULL AS DOUBLE) AS value_num, 'str' AS value_kind FROM good
UNION ALL SELECT workbook_id, 'cell', 'Line ' || CAST(sh AS VARCHAR), row_num, 2, CAST(q AS VARCHAR), CAST(q AS DOUBLE), 'int' FROM good
UNION ALL SELECT workbook_id, 'cell', 'Line ' || CAST(sh AS VARCHAR), row_num, 3, '=B' || CAST(row_num AS VARCHAR) || '*2', NULL, 'str' FROM good
UNION ALL SELECT DISTINCT workbook_id, 'merge', 'Line ' || CAST(sh AS VARCHAR), 1, 1, NULL, CAST(NULL AS DOUBLE), NULL FROM good
UNION ALL SELECT DISTINCT workbook_id, 'error', NULL, NULL, NULL, NULL, CAST(NULL AS DOUBLE), NULL FROM lines WHERE sup % 10 = 0
""")
def workbook_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed workbooks of all lines, triaged and read by sheet; every tenth file is cut off."""
    files = fixtures.workbook_files(spark, sf_dir)
    files = files.withColumns({"path": F.concat(F.lit("/in/"), "filename"), "length": F.length("content")})
    ok = intake.triage_files(files.drop("workbook_id", "filename")).where("status = 'ok'")
    records = intake.read_workbooks(ok)
    tabs = records.where("record_type = 'sheet'").select("workbook_id", "sheet_idx", F.col("sheet_name").alias("tab"))
    return records.where("record_type <> 'sheet'").join(tabs, ["workbook_id", "sheet_idx"], "left").select(
        F.regexp_extract("workbook_id", r"([0-9]+)\.xlsx$", 1).alias("workbook_id"),
        "record_type",
        F.col("tab").alias("sheet_name"),
        "row",
        "col",
        "value_str",
        "value_num",
        "value_kind",
    )


def _messy_cells(spark: SparkSession, sf_dir: str, ln: DataFrame) -> DataFrame:
    """The grid with headers in row 4, 9 or 10; in each section the third row repeats the headers, the seventh is a total and the eleventh blank."""
    place = lambda row: F.when(row > fixtures.HEADER_ROW, F.pmod(row - fixtures.HEADER_ROW - 1, F.lit(fixtures.PER_SECTION + 1))).otherwise(0)
    cells = fixtures.schedule_cells(spark, sf_dir, ln).withColumn("place", place(F.col("row")))
    # every line has cells, so its row is one of theirs
    spots = ln.select(*grid.SHEET, F.col("row_num").alias("row"), place(F.col("row_num")).alias("place")).where("place in (3, 7)")
    words = F.element_at(F.lit(fixtures.HEADERS), (F.pmod("sheet_idx", F.lit(3)) + 1).cast("int"))
    words = F.when(F.col("place") == 3, words).otherwise(F.array(F.lit("Sub Total")))
    told = spots.select(*grid.SHEET, "row", F.posexplode(words).alias("k", "value_str"))
    told = told.select(*grid.SHEET, "row", (F.col("k") + 1).alias("col"), "value_str", F.lit(None).cast("double").alias("value_num"), F.lit("str").alias("value_kind"))
    blank = F.col("place") == 11
    own = cells.where("place <> 3 and not (place = 7 and col = 1)").withColumns(
        {"value_str": F.when(blank, F.lit("  ")).otherwise(F.col("value_str")), "value_num": F.when(~blank, F.col("value_num")), "value_kind": F.when(blank, F.lit("str")).otherwise(F.col("value_kind"))}
    ).drop("place")
    moved = F.element_at(F.array(F.lit(0), F.lit(5), F.lit(6)), (F.pmod("sheet_idx", F.lit(3)) + 1).cast("int"))
    return own.unionByName(told).withColumn("row", F.when(F.col("row") >= fixtures.HEADER_ROW, F.col("row") + moved).otherwise(F.col("row")))


@query(f"""
spots AS (SELECT *, (rn - 1) % 19 + 1 AS place, CASE sh % 3 WHEN 0 THEN 0 WHEN 1 THEN 5 ELSE 6 END AS moved FROM lines)
SELECT workbook_id, sheet_idx, CAST(4 + moved AS INT) AS header_row, CAST(row_num + moved AS INT) AS row_num, {_SECTION} AS section, CASE WHEN place = 3 THEN 'Code:' ELSE {_CODE} END AS doc_code
FROM spots WHERE place NOT IN (7, 11) AND (place <> 3 OR sh % 3 = 1)
""")
def messy_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers in other rows, again below, totals and blank rows; `Code:` with its colon repeats no header."""
    ln = _lines(spark, sf_dir)
    cells = _messy_cells(spark, sf_dir, ln)
    h = settle(headers.find_header_row(cells))
    mapped, keep = settle(columns.map_columns(cells, h)), list(dict.fromkeys(["doc_code", *ECHO]))
    r = rows.drop_repeated_headers(rows.product_rows(cells, h, mapped, keep=keep, lying=_messy_cells(spark, sf_dir, grid.by_sheet(ln))))
    r = r.select(*grid.SHEET, "row_num", "section", F.col("doc_code.value_str").alias("doc_code"))
    return r.join(grid.shuffled(h.select(*grid.SHEET, "header_row")), grid.SHEET).select(*grid.SHEET, "header_row", "row_num", "section", "doc_code")


@query("""
named AS (SELECT workbook_id, MAX(CASE WHEN sheet_idx = 1 THEN 'Supplier ' || workbook_id || ' Finish Schedule' ELSE 'supplier ' || workbook_id END) FILTER (WHERE sheet_idx = 1 OR first > 1) AS schedule_name
          FROM (SELECT workbook_id, sheet_idx, MIN(sheet_idx) OVER (PARTITION BY workbook_id) AS first FROM lines) GROUP BY 1)
SELECT workbook_id, schedule_name, CAST(row_number() OVER (PARTITION BY workbook_id ORDER BY sheet_idx, row_num) AS INT) AS seq,
       CASE WHEN rf <> 'N' THEN 'P-' || CAST(pk AS VARCHAR) END AS doc_code, p_name AS product_name, CASE WHEN pk % 4 <> 0 THEN p_brand END AS brand, ' ' AS finish, q AS qty, p_size AS width, CAST(q AS DOUBLE) AS rrp
FROM lines JOIN named USING (workbook_id)
""")
def product_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON document for every 250 products of a workbook, written piece by piece and read back."""
    made = settle(products.ordered_products(settle(_products(spark, sf_dir))))
    made = made.withColumns({f: F.lit(None).cast("string") for f in products.FIELDS if f not in made.columns})
    names = settle(naming.schedule_name(fixtures.schedule_cells(spark, sf_dir), fixtures.schedule_sheets(spark, sf_dir)))
    path = place(spark)
    intake.write_products(made, path, names, split=250)
    seq = (F.col("part") * 250 + F.col("seq")).alias("seq")
    return intake.read_products(spark, path).select("workbook_id", "schedule_name", seq, "doc_code", "product_name", "brand", "finish", "qty", "width", "rrp")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
