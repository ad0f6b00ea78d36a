import json
import random

from books import xlsx

from sheetloom.operators import grid
from sheetloom.sources import intake


def _files(spark, files):
    return spark.createDataFrame([(p, len(c), bytearray(c)) for p, c in files.items()], "path string, length long, content binary")


def test_cells_merges_and_sheets(spark):
    book = xlsx({"Cover": [["Title"], [None, 3]], "Items": [[True, 2.5, "a & b"]]}, {"Cover": ["A1:C2"]})
    triaged = intake.triage_files(_files(spark, {"/in/one.xlsx": book}))
    parts = intake.split_records(intake.read_workbooks(triaged.where("status = 'ok'")))
    got = sorted(tuple(r)[1:] for r in parts["cells"].collect())
    assert got == [
        (0, 1, 1, "Title", None, "str"),
        (0, 2, 2, "3", 3.0, "int"),
        (1, 1, 1, "True", None, "bool"),
        (1, 1, 2, "2.5", 2.5, "float"),
        (1, 1, 3, "a & b", None, "str"),
    ]
    assert [tuple(r)[1:] for r in parts["merges"].collect()] == [(0, 1, 2, 1, 3)]
    assert sorted((r["sheet_idx"], r["sheet_name"], r["is_active"]) for r in parts["sheets"].collect()) == [(0, "Cover", True), (1, "Items", False)]
    assert parts["errors"].count() == 0


def test_bad_files_become_error_rows(spark):
    junk = b"PK\x03\x04" + b"x" * 200
    files = {"/in/a.csv": b"x" * 200, "/in/b.xlsx": b"", "/in/c.xlsx": b"PK", "/in/d.xlsx": b"y" * 200, "/in/e.xlsx": junk}
    triaged = intake.triage_files(_files(spark, files))
    assert {r["path"][-6:]: r["error"] for r in triaged.collect()} == {
        "/a.csv": "Invalid file type",
        "b.xlsx": "Empty file",
        "c.xlsx": "Invalid file",
        "d.xlsx": "Invalid file",
        "e.xlsx": None,
    }
    assert intake.error_rows(triaged).count() == 4
    records = intake.read_workbooks(triaged.where("status = 'ok'"))
    assert [r["error"] for r in intake.split_records(records)["errors"].collect()] == ["Failed to read workbook"]


def test_no_files(spark):
    triaged = intake.triage_files(_files(spark, {"x": b""}).limit(0))
    assert intake.read_workbooks(triaged).count() == 0


def test_products_written_and_nested(spark, tmp_path):
    kinds = {f: "int" if f in ("width", "length", "height", "qty") else "double" if f == "rrp" else "string" for f in intake.FIELDS}
    blank = dict.fromkeys(intake.FIELDS)
    rows = [{"workbook_id": "w", "seq": 2, **blank, "doc_code": "B"}, {"workbook_id": "w", "seq": 1, **blank, "doc_code": "A"}]
    products = spark.createDataFrame(rows, "workbook_id string, seq int, " + ", ".join(f"{f} {k}" for f, k in kinds.items()))
    names = spark.createDataFrame([("w", "Name"), ("none", "Other")], "workbook_id string, schedule_name string")
    intake.write_products(products, f"{tmp_path}/flat")
    assert spark.read.parquet(f"{tmp_path}/flat").count() == 2
    got = {r["workbook_id"]: [p["doc_code"] for p in r["products"]] for r in intake.nested_products(products, names).collect()}
    assert got == {"w": ["A", "B"], "none": []}


def test_long_and_wide_grids(spark, tmp_path):
    long = spark.createDataFrame([("w", 0, 1, 1, "a", None, "str"), ("w", 0, 1, 2, "3", 3.0, "int")], intake.CELLS)
    for fmt in ("parquet", "csv", "json"):
        writer = long.write.option("header", True) if fmt == "csv" else long.write
        writer.format(fmt).save(f"{tmp_path}/{fmt}")
        got = intake.read_cells(spark, f"{tmp_path}/{fmt}", fmt)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, long.collect()))
    wide = spark.createDataFrame([(1, "Code", None, 1.5, True), (2, None, 7, None, None)], "n int, a string, b int, c double, d boolean")
    got = sorted(tuple(r)[2:] for r in grid.rows_to_cells(wide, "n").collect())
    assert got == [(1, 1, "Code", None, "str"), (1, 3, "1.5", 1.5, "float"), (1, 4, "true", None, "bool"), (2, 2, "7", 7.0, "int")]


def test_errors_written(spark, tmp_path):
    triaged = intake.triage_files(_files(spark, {"/in/b.xlsx": b"", "/in/noext": b"x" * 200}))
    intake.write_errors(intake.error_rows(triaged), f"{tmp_path}/errors")
    got = {r["workbook_id"]: (r["error"], r["detail"]) for r in spark.read.parquet(f"{tmp_path}/errors").collect()}
    assert got["/in/b.xlsx"][0] == "Empty file" and "no extension" in got["/in/noext"][1]


def test_truth_and_manifest(spark, tmp_path):
    (tmp_path / "one.json").write_text(
        '{\n"schedule_name": "S", "layout_family": "normalized", "seed": 3, "mutations": ["swap"], "notes": {"layout": "x", "header_row": 4, "include_code_col": true},\n"products": [{"doc_code": "A", "qty": 2, "rrp": 1.5}, {"doc_code": null}]}',
    )
    got = sorted(
        (
            (
                r["seq"],
                r["schedule_name"],
                r["doc_code"],
                r["qty"],
                r["rrp"],
                r["notes"]["header_row"],
            ) for r in intake.read_truth(spark, str(tmp_path / "one.json")).collect()
        ),
    )
    assert got == [(0, "S", "A", 2, 1.5, 4), (1, "S", None, None, None, 4)]
    (tmp_path / "m.jsonl").write_text(
        '{"type": "base", "xlsx": "a.xlsx", "truth": "a.json", "seed": 1, "layout_family": "ffe_tracker", "mutations": []}\n{"type": "mutated", "xlsx": "b.xlsx"}\n',
    )
    assert [
        (r["type"], r["xlsx"], r["seed"]) for r in intake.read_manifest(spark, str(tmp_path / "m.jsonl")).orderBy("type").collect()
    ] == [("base", "a.xlsx", 1), ("mutated", "b.xlsx", None)]


def test_nested_json_written(spark, tmp_path):
    kinds = {f: "int" if f in ("width", "length", "height", "qty") else "double" if f == "rrp" else "string" for f in intake.FIELDS}
    rows = [{"workbook_id": "w", "seq": k, **dict.fromkeys(intake.FIELDS), "doc_code": c} for k, c in ((2, "B"), (1, "A"))]
    made = spark.createDataFrame(rows, "workbook_id string, seq int, " + ", ".join(f"{f} {k}" for f, k in kinds.items()))
    intake.write_products(made, f"{tmp_path}/json", spark.createDataFrame([("w", "Name")], "workbook_id string, schedule_name string"))
    got = spark.read.json(f"{tmp_path}/json").first()
    assert got["schedule_name"] == "Name" and [p["doc_code"] for p in got["products"]] == ["A", "B"]


def test_dates_and_one_cell_merges(spark):
    book = xlsx({"Items": [["x", 45296, 0.75, 45296.5, 61]]}, {"Items": ["A1", "B1:C1"]}, styles={"B1": 1, "C1": 2, "D1": 3, "E1": 4})
    triaged = intake.triage_files(_files(spark, {"/in/d.xlsx": book}))
    parts = intake.split_records(intake.read_workbooks(triaged))
    assert parts["errors"].count() == 0
    got = {r["col"]: (r["value_str"], r["value_kind"]) for r in parts["cells"].collect()}
    assert got == {
        1: ("x", "str"),
        2: ("2024-01-05 00:00:00", "other"),
        3: ("18:00:00", "other"),
        4: ("2024-01-05 12:00:00", "other"),
        5: ("61", "int"),
    }
    assert sorted((r["min_col"], r["max_col"]) for r in parts["merges"].collect()) == [(1, 1), (2, 3)]


def _made(spark, rows):
    kinds = {f: "int" if f in ("width", "length", "height", "qty") else "double" if f == "rrp" else "string" for f in intake.FIELDS}
    full = [{"workbook_id": w, "seq": n, **dict.fromkeys(intake.FIELDS), "doc_code": c} for w, n, c in rows]
    return spark.createDataFrame(full, "workbook_id string, seq int, " + ", ".join(f"{f} {k}" for f, k in kinds.items()))


def _documents(folder):
    """What the files hold, each line parsed by itself."""
    lines = [x for f in sorted(folder.glob("part-*")) for x in f.read_text().split("\n") if x.strip()]
    return [json.loads(x) for x in lines]


def test_documents_are_written_piece_by_piece(spark, tmp_path):
    odd = 'a "quoted"} ]\n, text\u2028 of \U0001f600'
    rows = [("w", n, f"c{n}") for n in range(1, 501)] + [("odd", 1, odd), ("no name", 1, "x"), (None, 1, "null"), ("twice", 1, "b"), ("twice", 1, "b"), ("gap", 7, "g")]
    random.Random(1).shuffle(rows)
    names = spark.createDataFrame([("w", "Name}"), ("odd", odd), ("empty", "None"), (None, None), ("twice", "A"), ("twice", "B"), ("gap", None)], "workbook_id string, schedule_name string")
    made = _made(spark, rows)
    intake.write_products(made, f"{tmp_path}/one", names)
    got = _documents(tmp_path / "one")
    assert len(got) == 7 == len({d.get("workbook_id") for d in got})
    by = {d.get("workbook_id"): (d.get("schedule_name"), [p["doc_code"] for p in d["products"]]) for d in got}
    assert by.pop("w") == ("Name}", [f"c{n}" for n in range(1, 501)])
    assert by == {"odd": (odd, [odd]), "no name": (None, ["x"]), "empty": ("None", []), None: (None, ["null"]), "twice": ("B", ["b", "b"]), "gap": (None, ["g"])}
    back = intake.read_products(spark, f"{tmp_path}/one")
    assert back.count() == 507 and back.where("workbook_id = 'empty'").first()["doc_code"] is None
    assert [r["seq"] for r in back.where("workbook_id = 'w'").orderBy("seq").collect()] == list(range(1, 501))


def test_documents_in_parts(spark, tmp_path):
    made = _made(spark, [("w", n, f"c{n}") for n in range(1, 251)] + [("v", 1, "x")])
    names = spark.createDataFrame([("w", "N"), ("none", "M")], "workbook_id string, schedule_name string")
    intake.write_products(made, f"{tmp_path}/parts", names, split=100)
    got = {(d["workbook_id"], d["part"]): (d["parts"], [p["doc_code"] for p in d["products"]]) for d in _documents(tmp_path / "parts")}
    want = {("w", k): (3, [f"c{n}" for n in range(100 * k + 1, min(250, 100 * k + 100) + 1)]) for k in range(3)}
    assert got == want | {("v", 0): (1, ["x"]), ("none", 0): (1, [])}


def test_no_product_list_in_the_plan_of_documents(spark):
    names = spark.createDataFrame([("w", "N")], "workbook_id string, schedule_name string")
    lines = intake.document_lines(_made(spark, [("w", 1, "a")]), names)
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "collect_set" not in plan
    assert intake.document_lines(_made(spark, []).limit(0), names.limit(0)).count() == 0
