"""Cell grids: long tables of cells, merged ranges, used ranges.

A sheet is keyed by (workbook_id, sheet_idx). `cells` has row, col, value_str, value_num,
value_kind; an empty cell is an absent row. `merges` has min_row, max_row, min_col, max_col.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import settle

SHEET = ["workbook_id", "sheet_idx"]
#: Last row and column that a sheet can have, and last column that a rule reads without being told.
LAST_ROW, LAST_SHEET_COL, LAST_COL = 1_048_576, 16_384, 30
VALUE = ["value_str", "value_num", "value_kind"]
_RANGE = ["min_row", "max_row", "min_col", "max_col"]


def computed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """`df` with the columns, each worked out once.

    Filters and projections above are not merged into these expressions: costly text rules that
    build on each other would multiply otherwise.
    """
    out = df
    for k, (n, c) in enumerate(columns.items()):  # one step each keeps generated code small
        out = out.withColumn(f"computed_{k}", F.explode(F.array(F.struct(c.alias(n)))))
    return out.select(*[df[c] for c in df.columns if c not in columns], *[f"computed_{k}.{n}" for k, n in enumerate(columns)])


def shuffled(table: DataFrame) -> DataFrame:
    """`table` for joins in which it may have as many rows as the grid has cells.

    Such tables are packed so well on disk that millions of rows fit under the size up to which Spark
    sends a file to every task by way of the driver; in memory they take a hundred times that.
    """
    return table.hint("merge")


def by_sheet(table: DataFrame) -> DataFrame:
    """`table` with the rows of each sheet in one task, so that what is made of it needs no shuffle to meet its sheet.

    For tables of which a sheet is one task's already. There are as many parts as the session shuffles into, and none are put
    together: a row may become many cells, so its bytes say little of the work.
    """
    return table.repartition(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), *SHEET)


def rows_to_cells(df: DataFrame, order_col: str, workbook_id: Column | None = None, sheet_idx: Column | None = None, kind: str = "str") -> DataFrame:
    """Cells of a headerless wide table: its columns but `order_col` become columns 1, 2, ...

    `order_col` numbers the rows. All values are text unless a column is numeric.
    """
    parts = []
    for c, t in ((c, t) for c, t in df.dtypes if c != order_col):
        numeric = t in ("tinyint", "smallint", "int", "bigint", "float", "double") or t.startswith("decimal")
        made = "float" if t in ("float", "double") or t.startswith("decimal") else "int" if numeric else "bool" if t == "boolean" else kind
        parts.append(
            F.struct(
                F.lit(len(parts) + 1).alias("col"),
                F.col(c).cast("string").alias("value_str"),
                (F.col(c).cast("double") if numeric else F.lit(None).cast("double")).alias("value_num"),
                F.lit(made).alias("value_kind"),
            ),
        )
    long = df.select(
        (workbook_id if workbook_id is not None else F.lit("0")).cast("string").alias("workbook_id"), (sheet_idx if sheet_idx is not None else F.lit(0)).cast("int").alias("sheet_idx"), F.col(order_col).cast("int").alias("row"), F.explode(F.array(*parts)).alias("c")
    )
    return long.select(*SHEET, "row", "c.*").where("value_str is not null")


def range_rows(cells: DataFrame, merges: DataFrame, last_row: int | None = None, used: DataFrame | None = None) -> DataFrame:
    """sheet, row, band: the ranges that cross a row, each with its columns, its corner and the corner's value, if it has one.

    A range meets its corner once and is told once for each of its rows, never cell by cell. One
    over whole columns ends at the last row that a cell or another range uses, one over whole
    rows at the last column used or read by any rule; up to `last_row` if it is given.
    Only sheets with such ranges are asked for what they use. `used` are the grid's cells, if `cells` are not all of them.
    """
    open_ended = merges.where((F.col("max_row") >= LAST_ROW) | (F.col("max_col") >= LAST_SHEET_COL)).select(*SHEET).distinct()
    used = (cells if used is None else used).select(*SHEET, "row", "col").unionByName(
        merges.select(
            *SHEET,
            F.when(F.col("max_row") < LAST_ROW, F.col("max_row")).alias("row"),
            F.when(F.col("max_col") < LAST_SHEET_COL, F.col("max_col")).alias("col"),
        ),
    ).join(open_ended, SHEET, "left_semi").groupBy(*SHEET).agg(F.max("row").alias("used_row"), F.max("col").alias("used_col"))
    used = used if not open_ended.isEmpty() else None
    corner = at_places(cells, merges, "min_row", "min_col").select(*SHEET, F.col("row").alias("min_row"), F.col("col").alias("min_col"), *VALUE, F.lit(True).alias("held"))
    ranges = merges.withColumns({"used_row": F.lit(None).cast("int"), "used_col": F.lit(None).cast("int")}) if used is None else merges.join(used, SHEET, "left")
    ranges = ranges.join(shuffled(corner), [*SHEET, "min_row", "min_col"], "left")
    row, col = F.col("max_row"), F.col("max_col")
    row = F.when(row >= LAST_ROW, F.greatest("min_row", F.coalesce("used_row", F.lit(0)))).otherwise(row)
    col = F.when(col >= LAST_SHEET_COL, F.greatest("min_col", F.coalesce("used_col", F.lit(0)), F.lit(LAST_COL))).otherwise(col)
    if last_row is not None:
        ranges, row = ranges.where(F.col("min_row") <= last_row), F.least(row, F.lit(last_row))
    band = F.struct("min_row", "min_col", col.alias("max_col"), *VALUE, "held")
    return ranges.select(*SHEET, F.explode(F.sequence("min_row", row)).alias("row"), band.alias("band"))


def _over(band: Column, col: Column) -> Column:
    return col.between(band["min_col"], band["max_col"])


def band_cells(bands: Column, only: Callable[[Column], Column] | None = None) -> Column:
    """(col, value) of the cells that a row's bands fill; where ranges overlap, that of the greatest corner. `only` says which columns."""
    corner = lambda b: F.struct(b["min_row"], b["min_col"])
    wanted = lambda k: F.lit(True) if only is None else only(k)

    def filled(band: Column) -> Column:
        free = lambda k: wanted(k) & ~F.exists(bands, lambda x: _over(x, k) & (corner(x) > corner(band)))
        columns = F.filter(F.sequence(band["min_col"], band["max_col"]), free)
        return F.transform(columns, lambda k: F.struct(k.alias("col"), *[band[c].alias(c) for c in VALUE]))

    return F.flatten(F.transform(F.filter(bands, lambda b: b["held"]), filled))


def _stretches(bands: Column) -> Column:
    """(min_col, max_col, value) of the columns that a row's bands fill. A band is one stretch as it is, unless it meets another; only then is it asked column by column."""
    one = lambda value, low, high: F.struct(low.cast("int").alias("min_col"), high.cast("int").alias("max_col"), *[value[c].alias(c) for c in VALUE])
    other = lambda x, b: (x["min_row"] != b["min_row"]) | (x["min_col"] != b["min_col"])
    meets = lambda b: F.exists(bands, lambda x: (x["min_col"] <= b["max_col"]) & (b["min_col"] <= x["max_col"]) & other(x, b))
    whole = F.transform(F.filter(bands, lambda b: b["held"]), lambda b: one(b, b["min_col"], b["max_col"]))
    cut = F.transform(band_cells(bands), lambda cell: one(cell, cell["col"], cell["col"]))
    return F.when((F.size(bands) > 1) & F.exists(bands, meets), cut).otherwise(whole)


def outside_bands(bands: Column, col: Column) -> Column:
    """No band of the row holds the column; null bands hold none."""
    return ~F.coalesce(F.exists(bands, lambda b: _over(b, col)), F.lit(False))


def fill_merged(cells: DataFrame, merges: DataFrame, last_row: int | None = None, used: DataFrame | None = None) -> DataFrame:
    """Every cell of a merged range takes the top-left value, an empty one included; rows up to `last_row` if it is given.

    Cells and ranges meet by row: what a range hides goes, what it fills is told from the row's bands, which are gathered once.
    """
    bands = settle(range_rows(cells, merges, last_row, used).groupBy(*SHEET, "row").agg(F.collect_list("band").alias("bands")))
    own = cells if last_row is None else cells.where(F.col("row") <= last_row)
    own = own.select(*SHEET, "row", "col", *VALUE).join(shuffled(bands), [*SHEET, "row"], "left").where(outside_bands(F.col("bands"), F.col("col")))
    filled = bands.select(*SHEET, "row", F.explode(_stretches(F.col("bands"))).alias("s")).select(*SHEET, "row", "s", F.explode(F.sequence("s.min_col", "s.max_col")).alias("col"))
    return own.drop("bands").unionByName(filled.select(*SHEET, "row", "col", *[F.col(f"s.{c}") for c in VALUE]))


def _level(size: Column) -> Column:
    """The smallest k with 2**k >= size."""
    return F.when(size <= 1, 0).otherwise(F.length(F.bin(size.cast("long") - 1))).cast("int")


def _tiles(low: str, high: str, level: str) -> Column:
    """The one or two tiles of 2**level that a stretch up to that long lies in."""
    return F.expr(f"sequence(shiftright({low} - 1, {level}), shiftright({high} - 1, {level}))")


#: Rows and tiles of TILE columns of a range that is told row by row; a larger one is told by tiles of its own size.
MOST_ROWS, MOST_TILES, TILE = 64, 16, 64


def _told(ranges: DataFrame) -> DataFrame:
    """`ranges` once for each of their rows and tiles of TILE columns (row, tile)."""
    tiles = F.sequence(_tile(F.col("min_col")), _tile(F.col("max_col")))
    return ranges.withColumn("row", F.explode(F.sequence("min_row", "max_row"))).withColumn("tile", F.explode(tiles))


def _tile(col: Column) -> Column:
    return F.floor((col - 1) / TILE).cast("int")


def _beside(points: DataFrame, ranges: DataFrame, how: str) -> DataFrame:
    """`points` p (with their tile) and the ranges m that hold them; both meet by row and tile, where at most as many ranges as columns can lie side by side."""
    keys = [F.col(f"p.{c}") == F.col(f"m.{c}") for c in [*SHEET, "row", "tile"]]
    return points.alias("p").join(shuffled(_told(ranges)).alias("m"), [*keys, F.col("p.col").between(F.col("m.min_col"), F.col("m.max_col"))], how)


def _apart(points: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame, tuple[DataFrame, DataFrame] | None]:
    """(points, ranges) of the sheets without large ranges, and those of the sheets with them, if there are any."""
    size = F.floor((F.col("max_col") - 1) / TILE) - F.floor((F.col("min_col") - 1) / TILE)
    large = merges.where((F.col("max_row") - F.col("min_row") >= MOST_ROWS) | (size >= MOST_TILES)).select(*SHEET).distinct()
    if large.isEmpty():
        return points, merges, None
    own = [df.join(large, SHEET, "left_semi").select(*[df[c] for c in df.columns]) for df in (points, merges)]
    rest = [df.join(large, SHEET, "left_anti").select(*[df[c] for c in df.columns]) for df in (points, merges)]
    return *rest, tuple(own)


def _by_tiles(points: DataFrame, merges: DataFrame, how: str) -> DataFrame:
    """`points` p with the range m that holds them, left or semi, where some ranges are large.

    Ranges are told by tiles: one of height up to 2**i and width up to 2**j lies in at most four
    tiles of that size, and few ranges that don't overlap fit into a tile that is no larger than twice
    each. A point asks one tile for each of the sizes that its sheet has, by equality, so the work
    grows with points and ranges and not with their product.
    """
    m = merges.select(*SHEET, "min_row", "max_row", "min_col", "max_col")
    m = m.withColumns({"i": _level(F.col("max_row") - F.col("min_row") + 1), "j": _level(F.col("max_col") - F.col("min_col") + 1)})
    sizes = m.groupBy(*SHEET).agg(F.collect_set(F.struct("i", "j")).alias("sizes"))
    tiles = m.withColumn("tile_row", F.explode(_tiles("min_row", "max_row", "i"))).withColumn("tile_col", F.explode(_tiles("min_col", "max_col", "j")))
    key = [*SHEET, "i", "j", "tile_row", "tile_col"]
    spots = points.select(*SHEET, "row", "col").distinct()
    asked = spots.join(sizes, SHEET).select(*SHEET, "row", "col", F.explode("sizes").alias("size")).select(*SHEET, "row", "col", "size.*")
    asked = asked.withColumns({"tile_row": F.expr("shiftright(row - 1, i)"), "tile_col": F.expr("shiftright(col - 1, j)")})
    met = asked.join(shuffled(tiles), key).where(F.col("row").between(F.col("min_row"), F.col("max_row")) & F.col("col").between(F.col("min_col"), F.col("max_col")))
    at = [*SHEET, "row", "col"]
    if how == "left_semi":
        return points.join(shuffled(met.select(*at).distinct()), at, "left_semi").select(*[points[c] for c in points.columns])
    m = shuffled(met.select(*at, *_RANGE)).alias("m")
    found = points.alias("p").join(m, [F.col(f"p.{c}") == F.col(f"m.{c}") for c in at], how)
    return found.select("p.*", *[F.col(f"m.{c}") for c in _RANGE])


def merged_range_of(points: DataFrame, merges: DataFrame) -> DataFrame:
    """`points` with the range that holds them, or nulls."""
    some, ranges, large = _apart(points, merges)
    met = _beside(some.withColumn("tile", _tile(F.col("col"))), ranges, "left").select(*[F.col(f"p.{c}") for c in points.columns], *[F.col(f"m.{c}") for c in _RANGE])
    return met if large is None else met.unionByName(_by_tiles(*large, "left"))


def is_merged(points: DataFrame, merges: DataFrame) -> DataFrame:
    """Those of `points` that a range holds."""
    some, ranges, large = _apart(points, merges)
    met = _beside(some.withColumn("tile", _tile(F.col("col"))), ranges, "left_semi").select(*points.columns)
    return met if large is None else met.unionByName(_by_tiles(*large, "left_semi"))


#: Numbers that places of a sheet are folded to, and how many of them are told as values.
FOLDED, FEW = 1 << 16, 50


def at_places(cells: DataFrame, spots: DataFrame, row: str, col: str) -> DataFrame:
    """`cells` without most of those whose row and column are no spot's in any sheet; the rest are left to an exact join.

    A few places in many sheets are asked for as a rule, so the grid need not be shuffled to meet them. Places are
    folded to numbers below FOLDED, and tasks get no more than those, however many spots there are. Up to FEW of them are
    told to the reading of the cells, before texts are made.
    """
    folded = lambda r, c: F.pmod(F.xxhash64(F.col(r).cast("long"), F.col(c).cast("long")), F.lit(FOLDED)).cast("int")
    asked = spots.select(folded(row, col).alias("folded")).distinct()
    few = [r[0] for r in asked.limit(FEW + 1).collect()]
    if len(few) <= FEW:
        return cells.where(folded("row", "col").isin(few))
    return cells.withColumn("folded", folded("row", "col")).join(F.broadcast(asked), "folded", "left_semi").select(*[cells[c] for c in cells.columns])


def is_merged_topleft(points: DataFrame, merges: DataFrame) -> DataFrame:
    return points.join(shuffled(merges.select(*SHEET, F.col("min_row").alias("row"), F.col("min_col").alias("col"))), [*SHEET, "row", "col"], "left_semi")


def merged_value(points: DataFrame, cells: DataFrame, merges: DataFrame) -> DataFrame:
    """`points` with the value seen there: the range's top-left one, or the cell's own."""
    return points_seen(points, cells, merges).select(*points.columns, *VALUE)


def points_seen(points: DataFrame, cells: DataFrame, merges: DataFrame) -> DataFrame:
    """`points` with the range that holds them, or nulls, and the value seen there.

    A range meets its corner's value first and brings it to its points, so points are shuffled once, by row and tile; what
    cells of their own say meets them there.
    """
    some, ranges, large = _apart(points, merges)
    corner = at_places(cells, ranges, "min_row", "min_col").select(*SHEET, F.col("row").alias("min_row"), F.col("col").alias("min_col"), *VALUE)
    ranges = ranges.select(*SHEET, *_RANGE).join(shuffled(corner), [*SHEET, "min_row", "min_col"], "left")
    told, value = [F.col(f"p.{c}") for c in points.columns], F.struct(*[F.col(f"m.{c}") for c in VALUE])
    met = _beside(some.withColumn("tile", _tile(F.col("col"))), ranges, "left")
    met = met.select(*told, "p.tile", *[F.col(f"m.{c}") for c in _RANGE], value.alias("seen"))
    one = at_places(cells, some, "row", "col").select(*SHEET, *[F.col(c).alias(f"{end}_{c}") for c in ("row", "col") for end in ("min", "max")], *VALUE)
    seen = _beside(met, one, "left").select(*told, *[F.col(f"p.{c}") for c in _RANGE], F.when(F.col("p.min_row").isNull(), value).otherwise(F.col("p.seen")).alias("seen"))
    out = seen.select(*points.columns, *_RANGE, "seen.*")
    if large is None:
        return out
    at = settle(_by_tiles(*large, "left").withColumns({"at_row": F.coalesce("min_row", "row"), "at_col": F.coalesce("min_col", "col")}))
    values = at_places(cells, at, "at_row", "at_col").select(*SHEET, F.col("row").alias("at_row"), F.col("col").alias("at_col"), *VALUE)
    return out.unionByName(at.join(shuffled(values), [*SHEET, "at_row", "at_col"], "left").select(*[at[c] for c in points.columns], *_RANGE, *VALUE))


def used_range(cells: DataFrame, *more: Column) -> DataFrame:
    """sheet, max_row, max_col and what `more` tells of a sheet's cells, in the same pass."""
    return cells.groupBy(*SHEET).agg(F.max("row").alias("max_row"), F.max("col").alias("max_col"), *more)
