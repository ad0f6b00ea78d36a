"""Files in, tables out: grids, workbooks, products, errors, ground truth."""

from __future__ import annotations

import datetime
import io
import itertools
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators.products import FIELDS
from .store import settle

CELLS = "workbook_id string, sheet_idx int, row int, col int, value_str string, value_num double, value_kind string"
LEAST_BYTES = 100
#: Records in one Arrow batch.
RECORDS_AT_ONCE = 65_536
#: Bytes of records and number of sheets that are put together in one batch; a larger one is a batch of its own.
RECORD_BYTES, PARTS_AT_ONCE = 16 << 20, 1_000


def read_cells(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A long table of cells; its schema is given, not inferred."""
    reader = spark.read.schema(CELLS)
    return (reader.option("header", True) if fmt == "csv" else reader).format(fmt).load(path)


def triage_files(files: DataFrame) -> DataFrame:
    """`files` (path, length, content) with workbook_id, filename, status, error, detail."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    ext = F.regexp_extract(name, r"(\.[^.]*)$", 1)
    f = files.withColumns({"workbook_id": F.col("path"), "filename": name})
    said = lambda error, detail: F.struct(F.lit(error).alias("error"), detail.cast("string").alias("detail"))
    checks = (
        F.when(name == "", said("No filename provided", F.lit(None)))
        .when(F.lower(ext) != ".xlsx", said("Invalid file type", F.concat(F.lit("Only .xlsx files are accepted, got: "), F.when(ext == "", "no extension").otherwise(ext))))
        .when(F.col("length") == 0, said("Empty file", F.lit("The file has no content")))
        .when(F.col("length") < LEAST_BYTES, said("Invalid file", F.lit("The file is too small to be a workbook")))
        .when(F.substring("content", 1, 4) != F.lit(b"PK\x03\x04"), said("Invalid file", F.lit("The file is not a zip archive")))
    )
    f = f.withColumn("c", checks)
    return f.withColumns(
        {"status": F.when(F.col("c").isNull(), "ok").otherwise("error"), "error": F.col("c.error"), "detail": F.col("c.detail")},
    ).drop("c")


_RECORDS = "record_type string, workbook_id string, filename string, sheet_idx int, sheet_name string, is_active boolean, row int, col int, max_row int, max_col int, value_str string, value_num double, value_kind string, error string, detail string"
_TYPES = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}
_ARROW = pa.schema([(n, _TYPES[t]) for n, t in (c.split() for c in _RECORDS.split(", "))])
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _column(letters: str) -> int:
    col = 0
    for ch in letters:
        col = col * 26 + ord(ch) - 64
    return col


def _place(ref: str) -> tuple[int, int]:
    letters, row = re.fullmatch(r"\$?([A-Z]+)\$?([0-9]+)", ref).groups()
    return int(row), _column(letters)


#: Numbers of the built-in formats that show dates or times.
_DATE_FORMATS = frozenset((*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)))


def _date_styles(z: zipfile.ZipFile) -> frozenset[int]:
    """Numbers of the cell styles that show dates or times."""
    if "xl/styles.xml" not in z.namelist():
        return frozenset()
    root = ElementTree.fromstring(z.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")): f.get("formatCode") or "" for f in root.iter(f"{_MAIN}numFmt")}
    plain = {k: re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", code).split(";")[0].lower() for k, code in own.items()}
    dates = _DATE_FORMATS | {k for k, code in plain.items() if re.search("[dmyhs]", code) and code != "general"}
    styles = root.find(f"{_MAIN}cellXfs")
    return frozenset(k for k, x in enumerate(styles if styles is not None else ()) if int(x.get("numFmtId", 0)) in dates)


def _moment(days: float, since_1904: bool) -> str:
    """A serial number as text: a time of day below 1, else a date and time. The first calendar counts a 29 February 1900 that wasn't."""
    if 0 <= days < 1:
        return str((datetime.datetime.min + datetime.timedelta(milliseconds=round(days * 86_400_000))).time())
    first = datetime.datetime(1904, 1, 1) if since_1904 else datetime.datetime(1899, 12, 31 if days < 60 else 30)
    return str(first + datetime.timedelta(milliseconds=round(days * 86_400_000)))


#: What a formula holds that doesn't move: texts, quoted names, brackets; then a cell, whole columns, whole rows.
_IN_FORMULA = re.compile(
    r"""("(?:[^"]|"")*"|'(?:[^']|'')*'|\[[^\]]*\])"""
    r"""|(?<![\w.$])(?:(\$?[A-Za-z]{1,3})(\$?[0-9]+)|(\$?[A-Za-z]{1,3}):(\$?[A-Za-z]{1,3})|(\$?[0-9]+):(\$?[0-9]+))(?![\w.(!])""",
)


def _letters(n: int) -> str:
    made = ""
    while n:
        n, k = divmod(n - 1, 26)
        made = chr(65 + k) + made
    return made


#: One end of a reference: the text to show, or the number that moves and whether it is a column's.
_End = tuple[str | None, int, bool]


def _end(said: str, is_col: bool) -> _End:
    return (said, 0, is_col) if said.startswith("$") else (None, _column(said.upper()) if is_col else int(said), is_col)


def formula_parts(formula: str) -> list[str | tuple[str, _End, _End]]:
    """A formula as texts that stay and references (what stands between their ends, both ends)."""
    parts, at = [], 0
    for m in _IN_FORMULA.finditer(formula):
        if m[1]:
            continue
        parts.append(formula[at : m.start()])
        ends = ("", _end(m[2], True), _end(m[3], False)) if m[2] else (":", _end(m[4], True), _end(m[5], True)) if m[4] else (":", _end(m[6], False), _end(m[7], False))
        parts.append(ends)
        at = m.end()
    return [*parts, formula[at:]]


def moved_parts(parts: list[str | tuple[str, _End, _End]], down: int, right: int) -> str:
    """The formula of `formula_parts` as it reads so many rows below and columns beside its own cell; what leaves the sheet is `#REF!`."""
    made = []
    for part in parts:
        if isinstance(part, str):
            made.append(part)
            continue
        between, *ends = part
        shown = []
        for said, n, is_col in ends:
            if said is None:
                n += right if is_col else down
                said = None if n < 1 else _letters(n) if is_col else str(n)
            shown.append(said)
        made.append("#REF!" if None in shown else between.join(shown))
    return "".join(made)


def moved_formula(formula: str, down: int, right: int) -> str:
    """`formula` as it reads so many rows below and columns beside its own cell; what leaves the sheet is `#REF!`."""
    return moved_parts(formula_parts(formula), down, right)


def _text(el: ElementTree.Element | None) -> str:
    """The text of a string and of its runs; how it is pronounced (phonetic runs) isn't part of it."""
    runs = [] if el is None else [t for x in el for t in ([x] if x.tag == f"{_MAIN}t" else x.findall(f"{_MAIN}t") if x.tag == f"{_MAIN}r" else [])]
    return "".join(t.text or "" for t in runs)


def _formula(f: ElementTree.Element, row: int, col: int, masters: dict[str, tuple]) -> str | None:
    """A formula; a cell that shares one gets its first cell's, moved. None if there is none to show."""
    if f.get("t") == "shared":
        if at := masters.get(f.get("si")):
            return moved_parts(at[0], row - at[1], col - at[2])
        if f.text:
            masters[f.get("si")] = (formula_parts(f"={f.text}"), row, col)
    return f"={f.text}" if f.text else None


_V, _F, _IS, _ROW, _CELL, _MERGE = (f"{_MAIN}{tag}" for tag in ("v", "f", "is", "row", "c", "mergeCell"))
_WHOLE = re.compile(r"-?[0-9]+").fullmatch


def _cell_value(c: ElementTree.Element, v: ElementTree.Element | None, inline: ElementTree.Element | None, shared: list[str], dates: frozenset[int], since_1904: bool, formula: str | None) -> tuple | None:
    if formula:
        return formula, None, "str"
    kind = c.get("t", "n")
    if kind == "inlineStr":
        return _text(inline), None, "str"
    if v is None or v.text is None:
        return None
    if kind == "s":
        return shared[int(v.text)], None, "str"
    if kind in ("str", "e"):
        return v.text, None, "str"
    if kind == "b":
        return str(v.text == "1"), None, "bool"
    n = float(v.text)
    if dates and int(c.get("s", 0)) in dates:
        return _moment(n, since_1904), None, "other"
    return (str(int(n)), n, "int") if _WHOLE(v.text) else (str(n), n, "float")


#: One sheet of a workbook with what it takes to read it: its part and the texts' part, as packed in the file.
_PARTS = "workbook_id string, filename string, sheet_idx int, sheet_name string, is_active boolean, since_1904 boolean, dates array<int>, sheet binary, sheet_packed boolean, sheet_crc long, texts binary, texts_packed boolean, texts_crc long, error string, detail string"
_TYPES |= {"binary": pa.binary(), "long": pa.int64(), "array<int>": pa.list_(pa.int32())}
_PARTS_ARROW = pa.schema([(n, _TYPES[t]) for n, t in (c.split() for c in _PARTS.split(", "))])
#: Bytes unpacked at once.
UNPACKED_AT_ONCE = 1 << 20


def _packed(z: zipfile.ZipFile, content: bytes, name: str) -> tuple[bytes, bool, int]:
    """A part as it lies in the file, if it is packed, and its checksum."""
    about = z.getinfo(name)
    if about.flag_bits & 1 or about.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
        raise ValueError(f"{name} is encrypted or packed in an unknown way")
    at = about.header_offset
    start = at + 30 + sum(struct.unpack("<HH", content[at + 26 : at + 30]))
    return content[start : start + about.compress_size], about.compress_type == zipfile.ZIP_DEFLATED, about.CRC


def _unpacked(data: bytes, packed: bool, crc: int) -> Iterator[bytes]:
    engine, found = zlib.decompressobj(-15) if packed else None, 0
    for at in range(0, len(data), UNPACKED_AT_ONCE):
        rest = data[at : at + UNPACKED_AT_ONCE]
        while rest:
            chunk, rest = (engine.decompress(rest, UNPACKED_AT_ONCE), engine.unconsumed_tail) if engine else (rest, b"")
            found = zlib.crc32(chunk, found)
            if chunk:
                yield chunk
    if engine and (chunk := engine.flush()):
        found = zlib.crc32(chunk, found)
        yield chunk
    if found != crc:
        raise zipfile.BadZipFile("a part's checksum is wrong")


def _elements(chunks: Iterator[bytes], *tags: str) -> Iterator[ElementTree.Element]:
    """The elements of these tags as they end; each is forgotten before the next."""
    parser, around = ElementTree.XMLPullParser(("start", "end")), []
    entered, left = around.append, around.pop
    for chunk in itertools.chain(chunks, (None,)):
        parser.close() if chunk is None else parser.feed(chunk)
        for event, el in parser.read_events():
            if event == "start":
                entered(el)
                continue
            left()
            if el.tag in tags:
                yield el
                around[-1].clear()


def sheet_parts(workbook_id: str, filename: str, content: bytes) -> list[dict]:
    """A row for each sheet of one workbook, with its part still packed."""
    z = zipfile.ZipFile(io.BytesIO(content))
    book = ElementTree.fromstring(z.read("xl/workbook.xml"))
    links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    texts = _packed(z, content, "xl/sharedStrings.xml") if "xl/sharedStrings.xml" in z.namelist() else (None, False, 0)
    dates, about = sorted(_date_styles(z)), book.find(f"{_MAIN}workbookPr")
    view = book.find(f"{_MAIN}bookViews/{_MAIN}workbookView")
    active = int(view.get("activeTab", 0)) if view is not None else 0
    base = {"workbook_id": workbook_id, "filename": filename, "dates": dates, "since_1904": about is not None and about.get("date1904") in ("1", "true")}
    base |= dict(zip(("texts", "texts_packed", "texts_crc"), texts, strict=True))
    made = []
    for k, s in enumerate(book.iter(f"{_MAIN}sheet")):
        target = links[s.get(_LINK)].lstrip("/")
        part = _packed(z, content, target if target.startswith("xl/") else f"xl/{target}")
        made.append(base | {"sheet_idx": k, "sheet_name": s.get("name"), "is_active": k == active} | dict(zip(("sheet", "sheet_packed", "sheet_crc"), part, strict=True)))
    return made


#: What the records of one sheet differ in.
_OF_RECORD = ("record_type", "row", "col", "max_row", "max_col", "value_str", "value_num", "value_kind", "sheet_name", "is_active")


def sheet_records(part: dict) -> Iterator[tuple]:
    """Records of one row of `sheet_parts`, as `_OF_RECORD` says: the sheet, its cells, its merges. A cell or row that names no place follows the one before."""
    yield "sheet", None, None, None, None, None, None, None, part["sheet_name"], part["is_active"]
    texts = _unpacked(part["texts"], part["texts_packed"], part["texts_crc"]) if part["texts"] is not None else None
    shared = [_text(si) for si in _elements(texts, f"{_MAIN}si")] if texts else []
    dates, since_1904, masters, row = frozenset(part["dates"]), part["since_1904"], {}, 0
    for el in _elements(_unpacked(part["sheet"], part["sheet_packed"], part["sheet_crc"]), _ROW, _MERGE):
        if el.tag == _MERGE:
            (r0, c0), *end = map(_place, el.get("ref").split(":"))
            r1, c1 = end[0] if end else (r0, c0)
            yield "merge", r0, c0, r1, c1, None, None, None, None, None
            continue
        row, col = int(el.get("r", row + 1)), 0
        for c in el:
            if c.tag != _CELL:
                continue
            row, col = _place(place) if (place := c.get("r")) else (row, col + 1)
            first = {}
            for child in c:
                first.setdefault(child.tag, child)
            f = first.get(_F)
            formula = None if f is None else _formula(f, row, col, masters)
            if value := _cell_value(c, first.get(_V), first.get(_IS), shared, dates, since_1904, formula):
                yield "cell", row, col, None, None, *value, None, None


def _record_batch(part: dict, held: list[tuple]) -> pa.RecordBatch:
    """Records of one sheet as a batch: its names are repeated."""
    own = dict(zip(_OF_RECORD, zip(*held, strict=True), strict=True))
    of_sheet = lambda f: pa.repeat(pa.scalar(part[f.name] if f.name in ("workbook_id", "filename", "sheet_idx") else None, f.type), len(held))
    return pa.RecordBatch.from_arrays([pa.array(own[f.name], f.type) if f.name in own else of_sheet(f) for f in _ARROW], schema=_ARROW)


def _gathered(batches: Iterator[pa.RecordBatch], rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """Small batches put together until they have so many rows or bytes."""
    held, n_rows, n_bytes = [], 0, 0
    for b in itertools.chain(batches, (None,)):
        if b is not None:
            held.append(b)
            n_rows, n_bytes = n_rows + b.num_rows, n_bytes + b.nbytes
        if held and (b is None or n_rows >= rows or n_bytes >= size):
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n_rows, n_bytes = [], 0, 0


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for k in range(b.num_rows):
            yield b.slice(k, 1).to_pylist()[0]


def _failed(row: dict, e: Exception) -> dict:
    return {"error": "Failed to read workbook", "detail": f"{type(e).__name__}: {e}"[:500]} | {k: row.get(k) for k in ("workbook_id", "filename", "sheet_idx")}


def read_workbooks(files: DataFrame) -> DataFrame:
    """Tagged records of `files` (workbook_id, filename, content); a file that fails gives an error record.

    Each file is opened once and dealt as its sheets, still packed; a task reads a sheet as a
    stream and holds a row, a batch of records and the workbook's shared texts. The records are
    written as they are read. A file of which any sheet breaks off gives one error (its first
    sheet's) and nothing else: a second pass over the written records leaves its others out.
    """

    def sheets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            try:
                made = sheet_parts(row["workbook_id"], row["filename"], row["content"])
            except Exception as e:  # noqa: BLE001  any broken file is a row of errors, not a lost job
                made = [_failed(row, e)]
            for one in made:
                yield pa.RecordBatch.from_pylist([one], schema=_PARTS_ARROW)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _rows(batches):
            records, held = iter(()) if part["error"] else sheet_records(part), []
            failed = {k: part[k] for k in ("workbook_id", "filename", "error", "detail")} if part["error"] else None
            while failed is None:
                try:
                    held = list(itertools.islice(records, RECORDS_AT_ONCE))
                except Exception as e:  # noqa: BLE001
                    failed = _failed(part, e)
                    break
                if not held:
                    break
                yield _record_batch(part, held)
            if failed:
                yield pa.RecordBatch.from_pylist([failed | {"record_type": "error"}], schema=_ARROW)

    parts = files.select("workbook_id", "filename", "content").mapInArrow(lambda batches: _gathered(sheets(batches), PARTS_AT_ONCE, UNPACKED_AT_ONCE), _PARTS)
    found = settle(parts.repartition("workbook_id", "sheet_idx").mapInArrow(lambda batches: _gathered(read(batches), RECORDS_AT_ONCE, RECORD_BYTES), _RECORDS))
    wrong = found.where("record_type = 'error'")
    first = settle(wrong.groupBy("workbook_id").agg(F.min_by(F.struct(*[c for c in found.columns if c != "workbook_id"]), F.coalesce("sheet_idx", F.lit(-1))).alias("e")))
    errors = first.select("workbook_id", "e.*").withColumn("sheet_idx", F.lit(None).cast("int"))
    return found.where("record_type <> 'error'").join(first.select("workbook_id"), "workbook_id", "left_anti").unionByName(errors)


def split_records(records: DataFrame) -> dict[str, DataFrame]:
    """cells, sheets, merges, errors of the records; write the records first if all are used."""
    of = lambda t: records.where(F.col("record_type") == t)
    return {
        "cells": of("cell").select("workbook_id", "sheet_idx", "row", "col", "value_str", "value_num", "value_kind"),
        "sheets": of("sheet").select("workbook_id", "filename", "sheet_idx", "sheet_name", "is_active"),
        "merges": of("merge").select("workbook_id", "sheet_idx", F.col("row").alias("min_row"), "max_row", F.col("col").alias("min_col"), "max_col"),
        "errors": of("error").select("workbook_id", "error", "detail"),
    }


def nested_products(products: DataFrame, names: DataFrame) -> DataFrame:
    """workbook_id, schedule_name, products: one row for each workbook, its products in order."""
    made = products.groupBy("workbook_id").agg(F.sort_array(F.collect_list(F.struct("seq", *FIELDS))).alias("products"))
    return names.join(made, "workbook_id", "left").select(
        "workbook_id",
        "schedule_name",
        F.coalesce(F.transform("products", lambda p: p.dropFields("seq")), F.array()).alias("products"),
    )


def document_lines(products: DataFrame, names: DataFrame, split: int | None = None) -> DataFrame:
    """text: the pieces of one JSON document for each workbook, in order within partitions: a head, each product, an end.

    No product list is ever held: pieces are shuffled and sorted by workbook and seq, and a task
    passes them on one by one. A workbook of the one table that the other lacks has a document too, without products or without
    a name; of several names the greatest counts, a null seq goes first and repeated ones stay. With `split`, a document
    has the products of that many seqs and tells its part (from 0) and how many there are, so that a workbook of any size spreads over tasks.
    """
    part = F.expr(f"(greatest(seq, 1) - 1) div {split}").cast("int") if split else F.lit(0)
    made = products.select("workbook_id", part.alias("part"), F.lit(1).alias("kind"), "seq", F.to_json(F.struct(*FIELDS)).alias("text"))
    none = F.lit(None)
    known = names.select("workbook_id", F.col("schedule_name").cast("string").alias("name"), F.lit(0).alias("part"))
    known = known.unionByName(made.select("workbook_id", none.cast("string").alias("name"), "part"))
    known = known.groupBy("workbook_id").agg(F.max("name").alias("schedule_name"), (F.max("part") + 1).alias("parts"))
    known = known.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    head = F.to_json(F.struct("workbook_id", "schedule_name", *(["part", "parts"] if split else [])))
    opened = F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.when(head == "{}", "").otherwise(","), F.lit('"products":['))
    ends = F.explode(F.array(F.struct(F.lit(0).alias("kind"), opened.alias("text")), F.struct(F.lit(2).alias("kind"), F.lit("]}\n").alias("text"))))
    around = known.select("workbook_id", "part", ends.alias("end"), none.cast("int").alias("seq")).select("workbook_id", "part", "end.kind", "seq", "end.text")
    order = ["workbook_id", "part", "kind", "seq"]
    follows = F.lag("kind").over(W.partitionBy("workbook_id", "part").orderBy("kind", "seq")) == 1
    pieces = made.unionByName(around).withColumn("text", F.when(follows & (F.col("kind") == 1), F.concat(F.lit(","), "text")).otherwise(F.col("text")))
    return pieces.sortWithinPartitions(*order).select("text")


def write_products(products: DataFrame, path: str, names: DataFrame | None = None, split: int | None = None) -> None:
    """The flat table as Parquet; with `names`, one JSON document a line for each workbook (or part of one), as in `document_lines`."""
    if names is None:
        products.write.mode("overwrite").parquet(path)
    else:  # pieces are parted by a blank, as JSON allows; a document is never cut between files
        document_lines(products, names, split).write.mode("overwrite").option("lineSep", " ").option("maxRecordsPerFile", 0).text(path)


def read_products(spark: SparkSession, path: str) -> DataFrame:
    """workbook_id, schedule_name, seq (from 1, in each document) and the fields of written documents; a workbook without products has one row of nulls."""
    t = spark.read.schema(f"workbook_id string, schedule_name string, part int, parts int, products array<struct<{_PRODUCT}>>").json(path)
    t = t.select("workbook_id", "schedule_name", "part", F.posexplode_outer("products").alias("at", "p"))
    return t.select("workbook_id", "schedule_name", "part", (F.col("at") + 1).alias("seq"), *[f"p.{f}" for f in FIELDS])


def error_rows(triaged: DataFrame) -> DataFrame:
    return triaged.where("status = 'error'").select("workbook_id", "error", "detail")


def write_errors(errors: DataFrame, path: str) -> None:
    errors.select("workbook_id", "error", "detail").write.mode("overwrite").parquet(path)


_PRODUCT = ", ".join(f"{f}: {'int' if f in ('width', 'length', 'height', 'qty') else 'double' if f == 'rrp' else 'string'}" for f in FIELDS)
TRUTH = f"schedule_name string, layout_family string, seed int, mutations array<string>, notes struct<layout: string, header_row: int, include_code_col: boolean>, products array<struct<{_PRODUCT}>>"


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """One row for each true product, with its file's name as workbook_id, and its order as seq."""
    t = spark.read.schema(TRUTH).json(path, multiLine=True).withColumn("workbook_id", F.input_file_name())
    return t.select(
        "workbook_id",
        "schedule_name",
        "layout_family",
        "mutations",
        "notes",
        F.posexplode_outer("products").alias("seq", "p"),
    ).select("*", "p.*").drop("p")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("type string, xlsx string, truth string, seed int, layout_family string, mutations array<string>").json(path)
