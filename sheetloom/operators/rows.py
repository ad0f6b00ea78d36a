"""Rows of a sheet: their kinds, and product rows from single and grouped layouts.

`wide_rows` brings every row below the header together once. What one row passes on to those below
it, as a section's name, is carried over runs of rows (`carried`), so no sheet is one task's work.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.lexicon import CANONICALS, DETAIL_KEYS, ECHO, ECHO_CODE, SKIP
from ..functions.text import let, nonempty, norm_cell_text, strip, truthy
from ..sources.store import settle
from .grid import LAST_COL, SHEET, VALUE, band_cells, by_sheet, computed, outside_bands, range_rows, shuffled

_DETAILS = "array<struct<row_num:int,key:string,value:string>>"


def wide_rows(cells: DataFrame, headers: DataFrame, column_map: DataFrame, max_rows: int | None = None, merges: DataFrame | None = None, lying: DataFrame | None = None) -> DataFrame:
    """One row for each sheet row below the header: c (column number to value), and a struct for each canonical name.

    c has the columns that rules read by number and those that are mapped, wherever they are.
    Where `merges` is given, `cells` are as read and the merged ranges are filled here, row by row.
    Cells are shuffled once, by sheet and run of rows; what is known of a sheet meets its rows there. `lying`: the same cells, made
    of a table that lies `by_sheet`, which are gathered where they are made. Rows beyond those of any sheet's header are not gathered.
    """
    where = F.col("row") > F.col("header_row")
    first, last = headers.agg(F.min("header_row"), F.max("header_row")).first()
    read_from, cells = cells, (cells if lying is None else lying).where(F.col("row") > (first or 0))
    if max_rows is not None:
        where &= F.col("row") <= F.col("header_row") + max_rows
        last = (last or 0) + max_rows
        cells = cells.where(F.col("row") <= last)
    names = column_map.groupBy(*SHEET).agg(F.map_from_entries(F.collect_list(F.struct("canonical", "col"))).alias("cols"))
    places = F.array(*[F.try_element_at("cols", F.lit(n)) for n in CANONICALS])  # looked up once for each sheet
    heads = headers.select(*SHEET, "header_row").join(shuffled(names), SHEET).withColumn("places", places)

    def read(col: Column) -> Column:
        return col.between(1, LAST_COL) | F.array_contains(F.map_values("cols"), col)

    found = cells.select(*SHEET, "row", F.struct("col", *VALUE).alias("cell"))
    seen = F.filter("cells", lambda x: read(x["col"]))
    gathered = [F.collect_list("cell").alias("cells")]
    if merges is not None:
        bands = settle(range_rows(read_from, merges, None if max_rows is None else last))
        bands = bands.where(F.col("row") > (first or 0))
        found = found.withColumn("band", F.lit(None).cast(bands.schema["band"].dataType)).unionByName(bands if lying is None else by_sheet(bands), allowMissingColumns=True)
        gathered.append(F.collect_list("band").alias("bands"))
        free = F.filter("cells", lambda x: read(x["col"]) & outside_bands(F.col("bands"), x["col"]))
        seen = F.when(F.size("bands") == 0, seen).otherwise(F.concat(free, band_cells(F.col("bands"), read)))
    found = found.withColumn("run", F.expr(f"row div {RUN}"))
    if lying is not None:
        rows = found.groupBy(*SHEET, "run", "row").agg(*gathered).join(heads.hint("shuffle_hash"), SHEET)
    else:
        runs = found.select(*SHEET, "run").distinct().join(shuffled(heads), SHEET)
        rows = found.repartition(*SHEET, "run").groupBy(*SHEET, "run", "row").agg(*gathered)
        rows = rows.join(runs.hint("shuffle_hash"), [*SHEET, "run"])
    rows = rows.where(where).withColumn("seen", seen).where(F.size("seen") > 0)
    c = F.map_from_entries(F.transform("seen", lambda x: F.struct(x["col"], F.struct(*[x[v].alias(v) for v in VALUE]))))
    rows = rows.select(*SHEET, "run", "header_row", F.col("row").alias("row_num"), c.alias("c"), "cols", "places")
    return named(rows.select("*", labels().alias("labels")))


def named(rows: DataFrame) -> DataFrame:
    """`rows` with a struct for each canonical name, from c and places; those that nobody asks for are not looked up."""
    names = [F.try_element_at("c", F.get("places", F.lit(k))).alias(n) for k, n in enumerate(CANONICALS)]
    return rows.select(*[c for c in rows.columns if c != "places"], *names)


def text_at(k: int | Column) -> Column:
    return F.try_element_at("c", F.lit(k) if isinstance(k, int) else k)["value_str"]


def labels() -> Column:
    """(col, text) of the cells in columns 1 to 9 that end with a colon, in order: what the rules for details and items look at. Most rows have none."""
    likely = F.filter(F.lit(list(range(1, 10))), lambda k: text_at(k).contains(":"))
    return F.filter(F.transform(likely, lambda k: F.struct(k.alias("col"), norm_cell_text(text_at(k)).alias("text"))), lambda x: x["text"].endswith(":"))


def _first(found: Column, told: Callable[[Column], Column]) -> Column:
    """What is told of the first that was found, null without one."""
    return F.get(F.transform(F.slice(found, 1, 1), told), F.lit(0))


def is_empty_row() -> Column:
    """No cell with more than blanks in columns 1 to 20 or a mapped one."""
    mapped = F.map_values("cols")
    return ~F.exists(
        F.map_entries("c"),
        lambda e: ((e["key"] <= 20) | F.array_contains(mapped, e["key"])) & nonempty(e["value"]["value_str"]).isNotNull(),
    )


def section_header() -> Column:
    """The section's name, or null: text repeated in three of columns 1 to 7, or capitals alone."""

    def told(name: Column) -> Column:
        repeats = F.size(F.filter(F.lit(list(range(2, 8))), lambda k: text_at(k).contains(name) & (strip(text_at(k)) == name))) + 1
        alone = F.lit(True)
        for n in ("specs", "manufacturer", "item_location"):
            v, number = F.col(n)["value_str"], F.col(n)["value_num"]
            alone &= ~truthy(v) | F.coalesce(number == 0, F.lit(False)) | F.coalesce(strip(v) == name, F.lit(False))
        capitals = (F.length(name) < 50) & (name == F.upper(name)) & (name != F.lower(name)) & ~name.rlike(r"(?U)\d") & ~name.rlike(r"^[A-Z]{1,3}-")
        return F.when((repeats >= 3) | (capitals & alone), name)

    return let(nonempty(text_at(1)), told)


def is_skip_row() -> Column:
    hit = F.exists(F.lit([1, 2, 3, 4]), lambda k: norm_cell_text(text_at(k)).rlike(SKIP))
    return hit | (norm_cell_text(F.col("image")["value_str"]) == "delivery")


def _truthy_cell(cell: Column) -> Column:
    return truthy(cell["value_str"]) & ~F.coalesce(cell["value_num"] == 0, F.lit(False))


def detail_row() -> Column:
    """(key, value) of a detail row, or null: known keys and `...:` in columns 3 to 6, up to `item:`."""
    known = lambda x: x["text"].isin(DETAIL_KEYS)
    loose = lambda x: (F.length(x["text"]) < 25) & (F.length(x["text"]) > 2) & nonempty(text_at(x["col"] + 1)).isNotNull()

    def told(x: Column) -> Column:
        after = F.try_element_at("c", x["col"] + 1)
        value = F.when(~known(x) | _truthy_cell(after), strip(after["value_str"]))
        return F.when(x["text"] != "item:", F.struct(strip(F.regexp_replace(x["text"], ":+$", "")).alias("key"), value.alias("value")))

    return _first(F.filter("labels", lambda x: x["col"].between(3, 6) & (known(x) | loose(x))), told)  # the leftmost column decides


def _items(first: int, last: int) -> Column:
    return F.filter("labels", lambda x: x["col"].between(first, last) & (x["text"] == "item:"))


def item_key(last: int = 6, first: int = 3) -> Column:
    """(value) of the first `item:` in the columns, its next cell; null without one."""
    return _first(_items(first, last), lambda x: F.struct(nonempty(text_at(x["col"] + 1)).alias("value")))


def is_item_row() -> Column:
    item = F.exists(_items(3, 6), lambda x: nonempty(text_at(x["col"] + 1)).isNotNull())
    return nonempty(F.col("doc_code")["value_str"]).isNotNull() | item


def layout_hit() -> Column:
    """What the first telling cell in columns 3 to 6 is: 'item', 'detail' or null."""
    telling = F.filter("labels", lambda x: x["col"].between(3, 6) & x["text"].isin(DETAIL_KEYS))
    return _first(telling, lambda x: F.when(x["text"] == "item:", "item").otherwise("detail"))


def detect_layout(rows: DataFrame, headers: DataFrame | None = None, sample_rows: int = 50) -> DataFrame:
    """sheet, layout: grouped where items have details, or details are many. Rows that are `judged` know their header's row and what they tell."""
    top = rows if headers is None else rows.drop("header_row").join(headers.select(*SHEET, "header_row"), SHEET)
    items, details = _hits(F.col("hit") if "hit" in rows.columns else layout_hit(), sample_rows)
    n = top.where(_among_first(sample_rows)).groupBy(*SHEET).agg(items.alias("i"), details.alias("d"))
    return n.select(*SHEET, _layout(F.col("i"), F.col("d")).alias("layout"))


def _among_first(sample_rows: int) -> Column:
    return F.col("row_num") <= F.col("header_row") + sample_rows


def _hits(hit: Column, sample_rows: int) -> tuple[Column, Column]:
    """How many of the first rows tell an item, and a detail."""
    items, details = (F.count(F.when((hit == what) & _among_first(sample_rows), 1)) for what in ("item", "detail"))
    return items, details


def _layout(items: Column, details: Column) -> Column:
    return F.when(((items > 0) & (details > 0)) | (details >= 5), "grouped").otherwise("single")


def judged(rows: DataFrame, keep: list[str] = CANONICALS) -> DataFrame:
    """Classified rows without their cells: what later steps ask of them, and the canonical columns in `keep`.

    `there`: a code (column 1 if none is mapped) or a location is there; `hit`: what the row tells of the layout.
    """
    code = F.coalesce(F.try_element_at("cols", F.lit("doc_code")), F.lit(1))
    there = _truthy_cell(F.try_element_at("c", code)) | _truthy_cell(F.col("item_location"))
    told = [*SHEET, "run", "header_row", "row_num", "kind", "section_name", "detail", "item", "item9"]
    return rows.select(*told, there.alias("there"), layout_hit().alias("hit"), *keep)


def classified(rows: DataFrame) -> DataFrame:
    """Rows with their kind: empty, section, skip, item, detail or other."""
    rows = rows.withColumns({"section_name": section_header(), "detail": detail_row(), "item": item_key(), "item9": item_key(9, 1)})
    kind = F.when(is_empty_row(), "empty").when(
        F.col("section_name").isNotNull(),
        "section",
    ).when(is_skip_row(), "skip").when(is_item_row(), "item").when(F.col("detail").isNotNull(), "detail").otherwise("other")
    return computed(rows, {"kind": kind})


#: Sheet rows that are scanned together.
RUN = 10_000


def carried(rows: DataFrame, values: dict[str, Column], run: int = RUN) -> DataFrame:
    """`rows` with each value's last non-null one at or above the row in its sheet.

    Sheets are scanned in runs of `run` rows; what a run leaves behind is carried to the next
    ones over one row for each run. So a sheet of any length spreads over tasks.
    """
    return _over_runs(_in_runs(rows, values, run), list(values)).drop("run")


def _in_runs(rows: DataFrame, values: dict[str, Column], run: int = RUN) -> DataFrame:
    """`rows` with their run and each value's last non-null one at or above the row in its run. `wide_rows` lie together by the run that they tell."""
    rows = rows if run == RUN and "run" in rows.columns else rows.withColumn("run", F.expr(f"row_num div {run}"))
    above = W.partitionBy(*SHEET, "run").orderBy("row_num").rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.withColumns({n: F.last(v, ignorenulls=True).over(above) for n, v in values.items()})


def _over_runs(rows: DataFrame, names: list[str]) -> DataFrame:
    """`_in_runs` made whole: values that are null in a run are those that the runs before it left.

    Only runs that something is left to are asked for, so sheets of one run bring no rows to the join.
    """
    before = W.partitionBy(*SHEET).orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    ends = rows.groupBy(*SHEET, "run").agg(*[F.max_by(n, "row_num").alias(n) for n in names])
    left = ends.select(*SHEET, "run", *[F.last(n, ignorenulls=True).over(before).alias(f"{n}_before") for n in names])
    left = settle(left.where(" or ".join(f"{n}_before is not null" for n in names)))
    rows = rows.join(left, [*SHEET, "run"], "left")
    return rows.withColumns({n: F.coalesce(n, f"{n}_before") for n in names}).drop(*[f"{n}_before" for n in names])


def _section() -> dict[str, Column]:
    return {"section": F.when(F.col("kind") == "section", F.col("section_name"))}


def _head() -> dict[str, Column]:
    """The number of a section's or an item's row."""
    return {"head_row": F.when(F.col("kind").isin("section", "item"), F.col("row_num"))}


def fill_section(rows: DataFrame, run: int = RUN) -> DataFrame:
    """`section`: the last section header above, null before the first."""
    return carried(rows, _section(), run)


def single_rows(rows: DataFrame) -> DataFrame:
    """Product rows where each row is one, of `judged` rows: a code or a location is there."""
    kept = rows.where(~F.col("kind").isin("empty", "section", "skip")).where("there")
    return kept.select(
        *SHEET,
        "row_num",
        "section",
        F.lit(None).cast("string").alias("item_name"),
        F.array().cast(_DETAILS).alias("detail_rows"),
        *_kept(rows),
    )


def _kept(rows: DataFrame) -> list[str]:
    return [c for c in CANONICALS if c in rows.columns]


def grouped_rows(rows: DataFrame, run: int = RUN) -> DataFrame:
    """Product rows where an item row gathers the detail rows below it; a section ends it.

    Rows are grouped by the number of the item row above them, which is carried over runs of rows.
    """
    return _grouped(carried(rows.where(F.col("kind").isin("section", "item", "detail")), _head(), run))


def _grouped(rows: DataFrame) -> DataFrame:
    """`grouped_rows` of rows that know the item or section row above them (head_row); only that row brings its cells to the group."""
    rows = rows.where(F.col("kind").isin("section", "item", "detail") & F.col("head_row").isNotNull())
    details = F.sort_array(
        F.collect_list(F.when(F.col("kind") == "detail", F.struct("row_num", F.col("detail.key").alias("key"), F.col("detail.value").alias("value")))),
    )
    head = F.struct(
        "kind",
        "row_num",
        "section",
        F.coalesce("item.value", F.when(F.col("item").isNull(), F.col("item9.value"))).alias("item_name"),
        *_kept(rows),
    )
    head = F.first(F.when(F.col("kind") != "detail", head), ignorenulls=True)
    groups = rows.groupBy(*SHEET, "head_row").agg(head.alias("h"), details.cast(_DETAILS).alias("detail_rows")).where("h.kind = 'item'")
    return groups.select(*SHEET, "h.row_num", "h.section", "h.item_name", "detail_rows", *[f"h.{n}" for n in _kept(rows)])


def drop_repeated_headers(products: DataFrame) -> DataFrame:
    """Without rows that repeat the header: a header word as code and two more of them elsewhere."""
    echoes = sum((norm_cell_text(F.col(n)["value_str"]).isin(words).cast("int") for n, words in ECHO.items()), F.lit(0))
    return products.where(~(norm_cell_text(F.col("doc_code")["value_str"]).isin(ECHO_CODE) & (echoes >= 2)))


def product_rows(
    cells: DataFrame, headers: DataFrame, column_map: DataFrame, max_rows: int | None = None, merges: DataFrame | None = None, keep: list[str] = CANONICALS, lying: DataFrame | None = None
) -> DataFrame:
    """Product rows of all sheets by their layout, with the canonical columns in `keep`; `merges` and `lying` as in `wide_rows`.

    Rows are written once, with what their run or sheet tells them while it still lies together, and without cells that nobody asks for.
    """
    rows = judged(classified(wide_rows(cells, headers, column_map, max_rows, merges, lying)), keep)
    if lying is not None:
        sheet = W.partitionBy(*SHEET)
        above = sheet.orderBy("row_num").rowsBetween(W.unboundedPreceding, W.currentRow)
        rows = rows.withColumns({n: F.last(v, ignorenulls=True).over(above) for n, v in (_section() | _head()).items()})
        rows = rows.withColumn("layout", _layout(*[n.over(sheet) for n in _hits(F.col("hit"), 50)]))
        rows = settle(rows.drop("section_name", "run", "hit", "header_row"))
        single, grouped = (rows.where(F.col("layout") == layout) for layout in ("single", "grouped"))
        return single_rows(single).unionByName(_grouped(grouped))
    rows = settle(_in_runs(rows, _section() | _head()).drop("section_name"))
    layouts = settle(detect_layout(rows))
    rows = _over_runs(rows, ["section", "head_row"]).drop("run")

    def of(layout: str) -> DataFrame:
        return rows.join(layouts.where(F.col("layout") == layout).select(*SHEET), SHEET, "left_semi")

    return single_rows(of("single")).unionByName(_grouped(of("grouped")))


def product_counts(products: DataFrame) -> DataFrame:
    return products.groupBy(*SHEET).agg(F.count("*").alias("products"))


def extract_all(cells: DataFrame, headers: DataFrame, column_map: DataFrame, merges: DataFrame | None = None, keep: list[str] = CANONICALS, lying: DataFrame | None = None) -> DataFrame:
    return product_rows(cells, headers, column_map, merges=merges, keep=keep, lying=lying).orderBy(*SHEET, "row_num")
