"""Headers to canonical columns: exact, partial and fuzzy."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.lexicon import FUZZY_THRESHOLD, MAPPER, ROOM_HEADERS, USABLE
from ..functions.text import norm_header
from ..sources.store import settle
from .grid import SHEET, computed, fill_merged, shuffled

MAX_COLS = 30
#: Numbers of header rows that are told as values.
FEW = 50
#: Synonym to canonical name; a synonym given twice keeps its first place and its last meaning.
LOOKUP = {s: canonical for canonical, words in MAPPER.items() for s in words}


def lexicon(spark: SparkSession) -> DataFrame:
    rows = [F.struct(F.lit(s).alias("synonym"), F.lit(c).alias("canonical"), F.lit(k).alias("ord")) for k, (s, c) in enumerate(LOOKUP.items())]
    return spark.range(1).select(F.inline(F.array(*rows)))


def synonyms(spark: SparkSession, canonical: str) -> DataFrame:
    return lexicon(spark).where(F.col("canonical") == canonical).orderBy("ord").select("synonym")


def match_exact(words: DataFrame) -> DataFrame:
    """`words` (norm) with the canonical name of those that are synonyms."""
    lex = F.broadcast(lexicon(words.sparkSession))
    return words.join(lex, words["norm"] == lex["synonym"]).select("norm", "canonical")


def _quoted(s: Column) -> Column:
    return F.concat(F.lit(r"(?U)\b\Q"), s, F.lit(r"\E\b"))


def match_partial(words: DataFrame) -> DataFrame:
    """The longest synonym of three letters or more that begins the header or stands in it as a phrase.

    `words` are distinct headers, few; the lexicon is of fixed size.
    """
    lex = F.broadcast(lexicon(words.sparkSession).where("length(synonym) >= 3"))
    begins = F.col("norm").startswith(F.col("synonym")) & ~F.regexp_like(
        F.substr("norm", F.length("synonym") + 1, F.lit(1)),
        F.lit(r"(?U)^[\p{L}\p{N}]"),
    )
    met = words.join(lex, begins | F.regexp_like("norm", _quoted(F.col("synonym"))))
    best = met.groupBy("norm").agg(F.min_by("canonical", F.struct(-F.length("synonym"), "ord")).alias("canonical"))
    return best


def _letters(word: str, places: dict[str, int]) -> np.ndarray:
    """How often each known letter stands in `word`."""
    found = np.zeros(len(places), dtype=np.int32)
    for ch in word:
        if (k := places.get(ch)) is not None:
            found[k] += 1
    return found


#: Letters of the synonyms, and each synonym's counts of them and its length.
_PLACES = {ch: k for k, ch in enumerate(sorted(set("".join(LOOKUP))))}
_COUNTS = np.stack([_letters(s, _PLACES) for s in LOOKUP])
_LENGTHS = np.array([len(s) for s in LOOKUP])


def likeness_bounds(texts: list[str]) -> np.ndarray:
    """No less than the likeness of each text (row) to each synonym (column): the letters they share, in any order."""
    counts = np.stack([_letters(t, _PLACES) for t in texts])
    shared = np.stack([np.minimum(counts, s).sum(axis=1) for s in _COUNTS], axis=1)
    return 2.0 * shared / (np.array([len(t) for t in texts])[:, None] + _LENGTHS)


def fuzzy_ratios(texts: list[str], threshold: float = FUZZY_THRESHOLD) -> list[str | None]:
    """The canonical name of each text's most alike synonym, if alike enough; the first of equals.

    Only synonyms whose bound reaches the threshold are compared, those of highest bound first,
    until no bound reaches the best likeness found.
    """
    names, made = list(LOOKUP.items()), []
    for text, bounds in zip(texts, likeness_bounds(texts) if texts else (), strict=True):
        best, found = (0.0, 0), None
        for k in sorted(np.flatnonzero((bounds >= threshold) & (bounds > 0)), key=lambda k: (-bounds[k], k)):
            if bounds[k] < best[0]:
                break
            r = (SequenceMatcher(None, text, names[k][0]).ratio(), -int(k))
            if r[0] > 0 and (found is None or r > best):
                best, found = r, names[k][1]
        made.append(found if best[0] >= threshold else None)
    return made


def match_fuzzy(words: DataFrame, threshold: float = FUZZY_THRESHOLD) -> DataFrame:
    """Ratcliff-Obershelp likeness, over distinct headers only; shared letters bound it for all synonyms at once."""

    @F.pandas_udf("string")
    def alike(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series(fuzzy_ratios(b.tolist(), threshold), dtype=object)

    return words.select("norm", alike("norm").alias("canonical")).where("canonical is not null")


def match_columns(words: DataFrame, use_fuzzy: bool = True) -> DataFrame:
    """norm, canonical, match_type of distinct headers: exact, then partial, then fuzzy, then none."""
    words = settle(words.select("norm").where("norm <> ''").distinct())
    exact = match_exact(words).withColumn("match_type", F.lit("exact"))
    rest = words.join(exact, "norm", "left_anti")
    partial = settle(match_partial(rest).withColumn("match_type", F.lit("partial")))
    found = exact.unionByName(partial)
    rest = rest.join(partial, "norm", "left_anti")
    if use_fuzzy:
        found = found.unionByName(match_fuzzy(rest).withColumn("match_type", F.lit("fuzzy")))
    return words.join(found, "norm", "left").select("norm", "canonical", F.coalesce("match_type", F.lit("none")).alias("match_type"))


def header_cells(cells: DataFrame, headers: DataFrame, max_cols: int = MAX_COLS, merges: DataFrame | None = None) -> DataFrame:
    """sheet, col, original, norm of the cells of header rows; ranges that cross such a row are filled where `merges` is given.

    Cells in rows that are no sheet's header row stay out of the join: the numbers of header rows are few, at most those scanned,
    so they are told to the reading of the cells (more than FEW are joined). Texts are folded after the join.
    """
    at = headers.select(*SHEET, F.col("header_row").alias("row"))
    numbers = at.select("row").distinct()
    few, own = [r[0] for r in numbers.limit(FEW + 1).collect()], cells.where(F.col("col") <= max_cols)
    own = own.where(F.col("row").isin(few)) if len(few) <= FEW else own.join(F.broadcast(numbers), "row", "left_semi")
    own = own.join(shuffled(at), [*SHEET, "row"])
    if merges is not None:
        crossed = merges.join(shuffled(headers.select(*SHEET, "header_row")), SHEET).where("header_row between min_row and max_row").drop("header_row")
        crossed = settle(crossed)
        if not crossed.isEmpty():
            own = fill_merged(cells, crossed).where(F.col("col") <= max_cols).join(shuffled(at), [*SHEET, "row"])
    own = own.select(*SHEET, "col", F.col("value_str").alias("original"))
    return computed(own, {"norm": norm_header(F.col("original"))}).where("norm <> ''")


def column_mapping_audit(cells: DataFrame, headers: DataFrame, use_fuzzy: bool = True, max_cols: int = MAX_COLS, merges: DataFrame | None = None) -> DataFrame:
    """sheet, col, original, norm, canonical, match_type of every header cell."""
    heads = settle(header_cells(cells, headers, max_cols, merges))
    return heads.join(match_columns(heads.select("norm"), use_fuzzy), "norm").select(*SHEET, "col", "original", "norm", "canonical", "match_type")


def map_columns(cells: DataFrame, headers: DataFrame, max_cols: int = MAX_COLS, use_fuzzy: bool = True, merges: DataFrame | None = None) -> DataFrame:
    """sheet, canonical, col: the first column of each name.

    Where a room or location header exists and nothing is a product name, the last `description`
    column is one.
    """
    audit = column_mapping_audit(cells, headers, use_fuzzy, max_cols, merges)
    sheet = W.partitionBy(*SHEET)
    room = F.max(F.col("norm").isin(ROOM_HEADERS).cast("int")).over(sheet)
    named = F.max(F.coalesce((F.col("canonical") == "product_name").cast("int"), F.lit(0))).over(sheet)
    audit = audit.withColumn("as_name", (F.col("norm") == "description") & (room == 1) & (named == 0))
    audit = audit.withColumn("canonical", F.when(F.col("as_name"), "product_name").otherwise(F.col("canonical"))).where("canonical is not null")
    return audit.groupBy(*SHEET, "canonical").agg(F.coalesce(F.max(F.when(F.col("as_name"), F.col("col"))), F.min("col")).alias("col"))


def usable_sheets(column_map: DataFrame) -> DataFrame:
    """Sheets with a code or a product name, and any column worth reading."""
    names = column_map.groupBy(*SHEET).agg(F.collect_set("canonical").alias("names"))
    return names.where(F.arrays_overlap("names", F.lit(["doc_code", "product_name"])) & F.arrays_overlap("names", F.lit(USABLE))).select(*SHEET)
