"""Whole sheets through the parse, and the goldens of its operators."""

import pytest
from pyspark.sql import functions as F

from sheetloom.functions import kv, units
from sheetloom.jobs.schedules import parse_products, parse_schedules
from sheetloom.operators import columns, grid, headers, naming, products, rows

CELL = "workbook_id string, sheet_idx int, row int, col int, value_str string, value_num double, value_kind string"
MERGE = "workbook_id string, sheet_idx int, min_row int, max_row int, min_col int, max_col int"
SHEETS = "workbook_id string, filename string, sheet_idx int, sheet_name string, is_active boolean"


def cells(spark, *sheets, workbook="w"):
    """Cells of sheets given as {row: [values]}."""
    return spark.createDataFrame([x for k, sheet in enumerate(sheets) for x in sheet_cells(workbook, k, sheet)], CELL)


def sheet_cells(workbook, k, sheet):
    for r, values in sheet.items():
        for c, v in enumerate(values, 1):
            if v is not None:
                number = float(v) if isinstance(v, int | float) else None
                yield workbook, k, r, c, str(v), number, "str" if number is None else "int"


def merges(spark, *areas):
    return spark.createDataFrame([("w", 0, *a) for a in areas], MERGE)


HEAD = ["Code", "Location", "Description", "Specs", "Manufacturer", "Qty", "Cost"]
PLAIN = {
    6: HEAD,
    7: ["KITCHEN"],
    8: ["A-1", "Room 1", "Tap", "FINISH: Brass\nSIZE: 600 W X 400 H MM", "NAME: Maker A", 2, 45.5],
    9: ["A-2", "Room 2", "Sink", "COLOUR - White", "NAME: Maker B", "3 pcs", "$1,200.50 + GST"],
}
GROUPED = {
    3: ["Code", "Image", "Location", "Label", "Details", "Qty"],
    5: [None, None, None, "Maker:", "dropped, as no item is open"],
    6: [None, None, None, "Item:", "Armchair", 2],
    7: [None, None, None, "Maker:", "Acme"],
    8: [None, None, None, "Colour:", "Sage"],
    9: [None, None, None, "Width:", "600 mm"],
    11: ["LOUNGE"],
    12: [None, None, None, "Maker:", "dropped, as a section closed the item"],
    13: [None, None, None, "Item:", "Table", 1],
    14: [None, None, None, "Material:", "Oak"],
    15: [None, None, None, "Weight:", "12 kg"],
}
#: Rows that change no product: others above, blank ones, totals and delivery, the header again, a far stray cell.
NOISE = {
    "above": {1: ["Title of it"], 3: ["note"]},
    "blank": {10: [], 12: ["", "  "]},
    "totals": {10: ["Total", None, None, None, None, None, 99], 11: ["Delivery"], 12: [None, "Grand  Total"]},
    "header": {10: HEAD},
    "stray": {40: ["", "", "", "", "", "", ""]},
}
BOOKS = {
    "w": [{4: HEAD, 5: ["Second floor"], 6: [None, "Room 1", "Tap"], 7: ["", "Room 2", "Tap"], 8: ["  ", "Room 3", "Tap"]}],
    "plain": [PLAIN],
    "sheets": [PLAIN, {2: HEAD, 3: ["A-1", "Room 9", "Other tap"], 4: ["B-1", "Room 3", "Lamp"], 5: [None, "Room 4", "No code"]}],
    "grouped": [GROUPED],
    **{name: [PLAIN | rows] for name, rows in NOISE.items()},
}


@pytest.fixture(scope="module")
def parsed(spark):
    """The products of all workbooks, in order, from one parse."""
    found = spark.createDataFrame([x for w, sheets in BOOKS.items() for k, sheet in enumerate(sheets) for x in sheet_cells(w, k, sheet)], CELL)
    sheets = spark.createDataFrame([(w, f"{w}_book.xlsx", k, "Items", k == 0) for w, made in BOOKS.items() for k in range(len(made))], SHEETS)
    made, names = parse_schedules(found, sheets, merges(spark, (5, 5, 1, 7)))
    assert {r["workbook_id"]: r["schedule_name"] for r in names.collect()} == {w: f"{w} book" for w in BOOKS}
    by = {w: [] for w in BOOKS}
    for r in made.orderBy("workbook_id", "seq").collect():
        by[r["workbook_id"]].append({k: v for k, v in r.asDict().items() if k != "workbook_id"})
    return by


def test_products_of_a_plain_sheet(parsed):
    got = parsed["plain"]
    assert [
        (p["doc_code"], p["product_name"], p["brand"], p["finish"], p["colour"], p["width"], p["height"], p["qty"], p["rrp"]) for p in got
    ] == [("A-1", "Tap", "Maker A", "Brass", None, 600, 400, 2, 45.5), ("A-2", "Sink", "Maker B", None, "White", None, None, 3, 1200.5)]
    assert [p["product_description"] for p in got] == ["KITCHEN | Room 1", "KITCHEN | Room 2"]


@pytest.mark.parametrize("name", NOISE)
def test_noise_changes_no_product(parsed, name):
    assert parsed[name] == parsed["plain"]


def test_later_sheet_adds_only_new_codes(parsed):
    assert [p["doc_code"] for p in parsed["sheets"]] == ["A-1", "A-2", "B-1", None]


def test_merged_section_and_blank_codes(parsed):
    assert [p["product_description"] for p in parsed["w"]] == [f"Second floor | Room {k}" for k in (1, 2, 3)]


def test_grouped_rows_through_the_parse(parsed):
    got = parsed["grouped"]
    assert [
        (p["product_name"], p["brand"], p["colour"], p["material"], p["width"], p["qty"]) for p in got
    ] == [("Armchair", "Acme", "Sage", None, 600, 2), ("Table", None, None, "Oak", None, 1)]
    assert got[1]["product_details"] == "WEIGHT: 12 kg" and got[1]["product_description"] == "LOUNGE"


def test_detail_rows_win_over_columns(spark):
    details = spark.sql(
        "SELECT array(named_struct('row_num', 2, 'key', ' Colour ', 'value', 'Red'), named_struct('row_num', 3, 'key', 'color', 'value', 'Blue'), named_struct('row_num', 4, 'key', 'dims', 'value', ' '), named_struct('row_num', 5, 'key', 'Dim', 'value', '60 cm')) AS d",
    )
    got = details.select(
        kv.details_to_kv(F.col("d")).alias("k"),
        kv.details_to_kv(F.lit(None).cast("array<struct<row_num:int,key:string,value:string>>")).alias("n"),
    ).first()
    assert [tuple(x) for x in got["k"]] == [("COLOUR", "Red"), ("SIZE", "60 cm")]
    assert got["n"] == []


def test_negative_numbers_are_told(spark):
    p = spark.createDataFrame(
        [(1, None, 2, 3, 4.0), (-1, 1, 1, 1, 1.0), (1, 1, 1, 1, -0.5), (None, None, None, None, None)],
        "width int, length int, height int, qty int, rrp double",
    )
    assert products.negative_products(p).count() == 2


def test_all_rows_in_order(spark):
    c = cells(spark, PLAIN, {1: HEAD, 2: ["Z", "Room"]})
    h = headers.find_header_row(c)
    got = rows.extract_all(c, h, columns.map_columns(c, h)).select("sheet_idx", "row_num").collect()
    assert [tuple(r) for r in got] == [(0, 8), (0, 9), (1, 2)]


HEADERS = {
    "code first": ({2: ["Location", "Qty", "Notes", "Cost"], 5: ["Code", "Qty", "Notes"], 9: ["Code", "Notes", "Qty"]}, 5),
    "last with a name": ({2: ["Product name", "Qty", "Notes"], 5: ["Item name", "Cost", "Notes"]}, 5),
    "first of equals": ({3: ["Room", "Qty", "Notes"], 5: ["Room", "Cost", "Notes"]}, 3),
}


@pytest.mark.parametrize("name", HEADERS)
def test_ties_of_header_rows(spark, name):
    sheet, row = HEADERS[name]
    assert [r["header_row"] for r in headers.find_header_row(cells(spark, sheet)).collect()] == [row]


def test_header_golden_and_columns(spark):
    c = cells(spark, {3: ["SPEC CODE", "IMAGE", "DESCRIPTION", "SPECIFICATIONS", "MANUFACTURER", "NOTES", "COST", "Ref"]})
    assert [(r["row"], r["score"]) for r in headers.score_header_rows(c).collect()] == [(3, 7)]
    got = {r["canonical"]: r["col"] for r in headers.header_columns(c, headers.find_header_row(c)).collect()}
    assert got == {"doc_code": 1, "image": 2, "item_location": 3, "specs": 4, "manufacturer": 5, "notes": 6, "cost": 7}


def test_header_words_match_in_order(spark):
    words = ["code", "width", "total amount", "casino", "zzz", "", "no"]
    got = spark.createDataFrame(
        [(k, w) for k, w in enumerate(words)],
        "k int, w string",
    ).select("k", headers.match_header(F.col("w")).alias("m")).orderBy("k").collect()
    assert [r["m"] for r in got] == ["doc_code", "doc_code", "cost", "qty", None, None, "qty"]


def test_mapper_golden(spark):
    c = cells(spark, {2: ["Code", "Area", "Item\nImage", "Description", "Qty", "Cost per unit $", "Total Cost $", "RRP"]})
    h = spark.createDataFrame([("w", 0, 2)], "workbook_id string, sheet_idx int, header_row int")
    got = {r["canonical"]: r["col"] for r in columns.map_columns(c, h).collect()}
    assert {
        k: got[k] for k in ("doc_code", "item_location", "image", "qty", "cost", "total_cost")
    } == {"doc_code": 1, "item_location": 2, "image": 3, "qty": 5, "cost": 6, "total_cost": 7}


def test_description_is_the_name_beside_a_room(spark):
    h = spark.createDataFrame([("w", k, 1) for k in range(3)], "workbook_id string, sheet_idx int, header_row int")
    c = cells(
        spark,
        {1: ["Code", "Room", "Description", "Description"]},
        {1: ["Code", "Description", "Qty"]},
        {1: ["Room", "Product name", "Description"]},
    )
    got = {(r["sheet_idx"], r["canonical"]): r["col"] for r in columns.map_columns(c, h).collect()}
    assert got[(0, "product_name")] == 4
    assert (1, "product_name") not in got and got[(1, "item_location")] == 2
    assert got[(2, "product_name")] == 2


def test_sheets_without_use_are_left_out(spark):
    m = spark.createDataFrame(
        [("w", 0, "doc_code", 1), ("w", 0, "qty", 2), ("w", 1, "doc_code", 1), ("w", 1, "image", 2), ("w", 2, "product_name", 1), ("w", 3, "qty", 1)],
        "workbook_id string, sheet_idx int, canonical string, col int",
    )
    assert sorted(r["sheet_idx"] for r in columns.usable_sheets(m).collect()) == [0, 2]


def test_synonyms_in_order(spark):
    assert [r["synonym"] for r in columns.synonyms(spark, "width").collect()] == ["width", "w", "wide"]
    assert columns.synonyms(spark, "nothing").count() == 0


REFERENCES = ["='[1]Cover Sheet'!A6", "='[1]Cover Sheet'!$A$6", "='Cover Sheet'!$A$6", "='Cover Sheet'!$A6", "='Cover Sheet'!A$6"]


def test_references_to_a_title(spark):
    c = cells(
        spark,
        {6: ["Residence Interior Finishes Schedule"]},
        {k: [r] for k, r in enumerate([*REFERENCES, "=SUM(A1:A3)", "='Missing'!A6", "='Cover Sheet'!A7", "plain", "=COVER!A6"], 1)},
        {6: ["Other Interior Finishes Schedule"]},
    )
    s = spark.createDataFrame(
        [("w", "f.xlsx", 0, "Cover Sheet ", False), ("w", "f.xlsx", 1, "Items", True), ("w", "f.xlsx", 2, "COVER", False)],
        SHEETS,
    )
    got = {r["row"]: r["target"] for r in naming.resolve_cell_refs(c, s).collect()}
    first = "Residence Interior Finishes Schedule"
    assert got == {**dict.fromkeys(range(1, 6), first), 10: "Other Interior Finishes Schedule"}
    # the active sheet's first row names the schedule
    assert [r["schedule_name"] for r in naming.schedule_name(c, s).collect()] == [first]


def test_names_from_covers_labels_and_files(spark):
    def name(*sheets, names=("Items",), file="my_schedule.xlsx"):
        s = spark.createDataFrame([("w", file, k, n, k == 0) for k, n in enumerate(names)], SHEETS)
        return [r["schedule_name"] for r in naming.schedule_name(cells(spark, *sheets), s).collect()][0]

    labels = {1: ["Job No.", "123"], 2: ["Date", "1/2/2020"]}
    assert name(labels) == "my schedule"
    assert name(labels, {3: ["Schedule name:", "Harbour House"]}, names=("Items", "The COVER")) == "Harbour House"
    assert name(labels, {6: ["Harbour Interior Works (FF&E Tracker)"]}, names=("Items", "cover")) == "Harbour Interior Works"
    assert name({1: ["Schedule name", "Level 3 Fitout"]}) == "Level 3 Fitout"
    assert name({1: ["Project: Harbour House Interiors"], 2: ["Notes"]}) == "Project: Harbour House Interiors"
    assert name({1: ["note"]}, file="") == "Unknown Schedule"


def test_no_cells_no_products(spark):
    assert parse_products(cells(spark, PLAIN).where("1 = 0"), merges(spark)).count() == 0


def test_merges_over_whole_columns_end_with_the_sheet(spark):
    c = cells(spark, {1: ["head", "x"], 2: ["gone"], 5: [None, "last"]})
    got = grid.fill_merged(c, merges(spark, (1, 1_048_576, 1, 1), (3, 4, 2, 16_384)))
    assert got.where("col = 1").count() == 5 and got.where("value_str = 'head'").count() == 5
    assert grid.fill_merged(c, merges(spark, (1, 1, 1, 16_384))).where("value_str = 'head'").agg(F.max("col")).first()[0] == 30


KV_LINES = {
    "A: b": ("A", "b"),
    "Size max : 3": ("SIZE MAX", "3"),
    "sheet size - 5 X 6": ("SIZE", "5 X 6"),
    "FINISH- MATT": ("FINISH", "MATT"),
    "LEAD-TIME: 3": ("LEAD-TIME", "3"),
    "LEAD-TIME = 3": ("LEAD-TIME", "3"),
    "W = 10": ("WIDTH", "10"),
    "9A: x": None,
    "A:": None,
    "A-B": None,
    "a key that is far too long to be one: but = 4": None,
    "ratio 3:4 - x": ("RATIO 3", "4 - x"),
    "what? - yes": None,
    "": None,
    "A B : c ": ("A B", "c"),
}


def test_lines_of_key_and_value(spark):
    got = spark.createDataFrame(
        [(k, t) for k, t in enumerate(KV_LINES)],
        "k int, t string",
    ).select("k", kv.parse_line(F.col("t")).alias("p")).orderBy("k").collect()
    assert [r["p"] and tuple(r["p"]) for r in got] == list(KV_LINES.values())


def test_kv_aliases_pipes_and_plain_lines(spark):
    t = "PRODUCT: ICONIC|COMPOSITION: 80% WOOL\nplain\n\nMATERIAL: second\nCARPET THICKNESS - 9 MM"
    row = spark.createDataFrame([(t,)], "t string").select(
        kv.parse_kv(F.col("t")).alias("kv"),
        kv.non_kv_lines(F.col("t")).alias("plain"),
        kv.parse_kv_multi(F.col("t")).alias("multi"),
    ).first()
    assert [tuple(x) for x in row["kv"]] == [("PRODUCT", "ICONIC"), ("MATERIAL", "80% WOOL"), ("CARPET_THICKNESS", "9 MM")]
    assert row["plain"] == ["plain"]
    assert row["multi"]["MATERIAL"] == ["second"] and row["multi"]["PRODUCT"] == ["ICONIC|COMPOSITION: 80% WOOL"]


DIMENSIONS = {
    "600 W X 600 H MM": (600, None, 600),
    "220 W X 2200 L X 3 T CM": (2200, 22000, 30),
    "1200 (W) x 800 (D) x 330 (H) mm": (1200, 800, 330),
    "600 X 400 X 200 MM": (600, 400, 200),
    "600 × 600 mm": (600, None, 600),
    "600 X 400": (None, None, None),
    "3.66 METRES": (3660, None, None),
    "3,5 cm": (35, None, None),
    "WIDTH: 600 mixed": (600_000, None, None),
    "HEIGHT: 10 mm\nDEPTH - 20 mm\nWIDTH 30": (30, None, 10),
    "DEPTH: 20 mm": (None, None, 20),
    "THICKNESS: 9 mm\nSIZE: 600 X 600 MM": (600, None, 600),
    "THICKNESS: 9 mm\nSIZE: 600 X 500 MM": (600, 500, 9),
    "WIDTH: 5 m, 100 W X 200 L MM": (5000, 200, None),
    "LENGTH: 2\"": (None, 51, None),
    "1,200 mm": (1, None, None),
    "nothing": (None, None, None),
    None: (None, None, None),
}


def test_dimensions_by_rule(spark):
    got = spark.createDataFrame(
        [(k, t) for k, t in enumerate(DIMENSIONS)],
        "k int, t string",
    ).select("k", units.parse_dimensions(F.col("t")).alias("d")).orderBy("k").collect()
    assert {t: tuple(r["d"]) for t, r in zip(DIMENSIONS, got, strict=True)} == DIMENSIONS


def test_lengths(spark):
    want = {
        "10MM": 10,
        '3.9"': 99,
        "2.5 cm": 25,
        "about 12 mm thick": 12,
        "12 thick": 12,
        "1 metre": 1000,
        "2 inches": 51,
        "x": None,
        None: None,
        "2.5": 2,
    }
    got = spark.createDataFrame(
        [(k, t) for k, t in enumerate(want)],
        "k int, t string",
    ).select("k", units.parse_mm(F.col("t")).alias("m")).orderBy("k").collect()
    assert {t: r["m"] for t, r in zip(want, got, strict=True)} == want
