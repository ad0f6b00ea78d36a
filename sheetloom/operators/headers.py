"""Header rows and schedule sheets."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lexicon import DETECTOR, REQUIRED, SUPPORTING
from ..functions.text import norm_header_first_line
from ..sources.store import settle
from .grid import SHEET, computed, fill_merged

SCAN_ROWS, SCAN_COLS, LEAST = 50, 20, 2
#: Synonyms as they compare: a trailing stop is cut from headers too.
_SYNONYMS = [(s.rstrip("."), canonical) for canonical, words in DETECTOR.items() for s in words]
#: Those that can be the first within a header: no synonym before them is within them.
_WITHIN = [s for k, (s, _) in enumerate(_SYNONYMS) if not any(t in s for t, _ in _SYNONYMS[:k])]
_CANONICAL = {s: canonical for s, canonical in reversed(_SYNONYMS)}  # the first one stays


def _tree(words: list[str], blank: str = " ") -> str:
    """A pattern that finds any of the words; words that begin alike share a branch, so few branches are tried at a place."""
    if "" in words:  # a word ends here, what is longer holds it
        return ""
    ends = {ch: _tree([w[1:] for w in words if w[0] == ch], blank) for ch in dict.fromkeys(w[0] for w in words)}
    made = [(blank if ch == " " else re.escape(ch)) + rest for ch, rest in ends.items()]
    return made[0] if len(made) == 1 else f"(?:{'|'.join(made)})"


#: What a text must hold to be a header: every synonym holds one of these words, blanks of any kind and number stand for one.
_ANY = _tree(_WITHIN, blank=r"(?U:\s+)")


def match_header(norm: Column) -> Column:
    """The canonical name of a normalised header: a synonym as it is, else the first one within it, else null."""
    known = F.create_map(*[F.lit(x) for pair in _CANONICAL.items() for x in pair])
    holds = {c: [norm.contains(s) for s in _WITHIN if _CANONICAL[s] == c] for c in DETECTOR}
    within = F.coalesce(*[F.when(reduce(or_, found), c) for c, found in holds.items() if found])
    return F.when(norm.isin(list(_CANONICAL)), F.try_element_at(known, norm)).otherwise(within)


def header_matches(cells: DataFrame, max_scan: int = SCAN_ROWS, merges: DataFrame | None = None) -> DataFrame:
    """sheet, row, col, canonical of the first rows and columns. Cells are matched where they are read, without a join.

    Texts without any header word are told by one pattern before they are folded. Where `merges` is
    given, what was matched fills the merged ranges: few cells meet them, and no text.
    """
    line = F.substring_index("value_str", "\n", 1)
    top = computed(
        cells.where((F.col("row") <= max_scan) & (F.col("col") <= SCAN_COLS)).where(F.lower(line).rlike(_ANY)).select(*SHEET, "row", "col", "value_str"),
        {"norm": norm_header_first_line(F.col("value_str"))},
    )
    found = computed(top.select(*SHEET, "row", "col", "norm"), {"canonical": match_header(F.col("norm"))}).drop("norm").where("canonical is not null")
    if merges is None:
        return found
    as_cells = found.select(*SHEET, "row", "col", F.col("canonical").alias("value_str"), F.lit(None).cast("double").alias("value_num"), F.lit("str").alias("value_kind"))
    filled = fill_merged(settle(as_cells), merges, max_scan, used=cells)
    return filled.where((F.col("col") <= SCAN_COLS) & F.col("value_str").isNotNull()).select(*SHEET, "row", "col", F.col("value_str").alias("canonical"))


#: The bit of each canonical name.
_BIT = {c: 1 << k for k, c in enumerate(sorted(DETECTOR))}


def _any_bit(names: list[str]) -> Column:
    return F.col("found").bitwiseAND(F.lit(sum(_BIT[c] for c in names))) != 0


def _row_bits(matches: DataFrame, columns: bool = False) -> DataFrame:
    """sheet, row, found: the names of a row as bits, which add up without a list for each row; with `columns` also each name's first one (firsts)."""
    bits = F.create_map(*[F.lit(x) for pair in _BIT.items() for x in pair])
    first = [F.min(F.when(F.col("canonical") == c, F.col("col"))).alias(c) for c in _BIT] if columns else []
    r = matches.groupBy(*SHEET, "row").agg(F.bit_or(F.element_at(bits, F.col("canonical"))).alias("found"), *first)
    return r.select(*SHEET, "row", "found", F.struct(*_BIT).alias("firsts")) if columns else r


def _names_of(found: Column) -> Column:
    return F.filter(F.lit(list(_BIT)), lambda _, k: F.getbit(found, k) == 1)


def score_header_rows(cells: DataFrame, max_scan: int = SCAN_ROWS) -> DataFrame:
    return _row_bits(header_matches(cells, max_scan)).select(*SHEET, "row", F.bit_count("found").alias("score"), _names_of(F.col("found")).alias("canonicals"))


def find_header_row(cells: DataFrame, max_scan: int = SCAN_ROWS, merges: DataFrame | None = None) -> DataFrame:
    """sheet, header_row, canonicals of each sheet that has a header; `cells` are as read where `merges` is given.

    Among the rows of highest weight: the first with doc_code, else the last with product_name,
    else the first.
    """
    best = _best_rows(_row_bits(header_matches(cells, max_scan, merges)))
    return best.select(*SHEET, F.col("row").alias("header_row"), _names_of(F.col("found")).alias("canonicals"))


def find_header_columns(cells: DataFrame, max_scan: int = SCAN_ROWS, merges: DataFrame | None = None) -> DataFrame:
    """sheet, header_row, canonical, col: each sheet's header row with the first column of each of its names, from one pass over the cells."""
    best = _best_rows(_row_bits(header_matches(cells, max_scan, merges), columns=True))
    names = F.array(*[F.struct(F.lit(c).alias("canonical"), F.col("firsts")[c].alias("col")) for c in _BIT])
    return best.select(*SHEET, F.col("row").alias("header_row"), F.inline(names)).where("col is not null")


def _best_rows(r: DataFrame) -> DataFrame:
    """The header row among the rows of `_row_bits`, for each sheet that has one."""
    told = [c for c in r.columns if c not in SHEET]
    r = r.where(F.bit_count("found") >= LEAST)
    required, support = _any_bit(REQUIRED), F.bit_count(F.col("found").bitwiseAND(F.lit(sum(_BIT[c] for c in SUPPORTING))))
    weight = F.bit_count("found") + 2 * required.cast("int") + (support > 0).cast("int")
    # one number orders a sheet's rows: weight, then what the row has, then its place
    kind = F.when(_any_bit(["doc_code"]), 2).when(required, 1).otherwise(0)
    place = (weight * 4 + kind).cast("long") * (1 << 32) + F.when(kind == 1, F.col("row")).otherwise((1 << 31) - F.col("row").cast("long"))
    best = r.withColumns({"place": place, "enough": required | (support >= 2)}).groupBy(*SHEET).agg(*[F.max_by(c, "place").alias(c) for c in (*told, "enough")])
    return best.where("enough")


def header_columns(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """sheet, canonical, col: the first column of each canonical name in the header row."""
    at = header_matches(cells).join(headers.select(*SHEET, F.col("header_row").alias("row")), [*SHEET, "row"])
    return at.groupBy(*SHEET, "canonical").agg(F.min("col").alias("col"))


def is_schedule_sheet(canonicals: Column) -> Column:
    support = F.size(F.array_intersect(canonicals, F.lit(SUPPORTING)))
    return (F.array_contains(canonicals, "doc_code") & (support >= 1)) | (F.array_contains(canonicals, "product_name") & (support >= 2))


def schedule_sheets(cells: DataFrame, sheets: DataFrame) -> DataFrame:
    """workbook_id, sheet_idx, sheet_name, header_row of qualifying sheets."""
    found = find_header_row(cells).where(is_schedule_sheet(F.col("canonicals")))
    return found.join(sheets, SHEET).select(*SHEET, "sheet_name", "header_row")
