"""From raw documents to shards: quality rules, near-duplicates, decontamination, mixing, sharding.

Every stage takes (spark, docs, sf_dir) and returns a table that is written and read again as
the next one's docs. All but the last return the columns of `docs`, whatever else is among them;
an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetloom.llm import decontaminate, mixing, near_dup, quality_rules, sharding
from sheetloom.llm.store import mark, release, settle, table


#: The columns of a stage's own table: the row's key, and the row as it came, whatever its columns are called.
ROW, DOC = "row", "doc"


def _keyed(docs: DataFrame) -> DataFrame:
    """(row, doc) for each row of `docs`: row is the doc_id, or where an id is null or repeated, a number written with the rows."""
    ids = docs.select(F.col("doc_id").cast("long").alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    doc = F.struct(*[docs[c] for c in docs.columns]).alias(DOC)
    if ids.where("id is null or n > 1").isEmpty():
        return docs.select(F.col("doc_id").cast("long").alias(ROW), doc)
    return settle(docs.select(F.monotonically_increasing_id().alias(ROW), doc))


def _by_row(keyed: DataFrame) -> DataFrame:
    """The table for an operator: the columns that operators read, with the row's key as doc_id."""
    read = [c for c in ("text", "lang", "source") if c in keyed.schema[DOC].dataType.names]
    return keyed.select(F.col(ROW).alias("doc_id"), *[f"{DOC}.{c}" for c in read])


def _growing(rows: DataFrame) -> DataFrame:
    """`rows` grow with the documents: joined by a shuffle at every size, so that a small run shows what a large one takes."""
    return rows.hint("merge")


def _without(keyed: DataFrame, rows: DataFrame) -> DataFrame:
    """The documents but for those rows whose key is in `rows` (doc_id)."""
    gone = settle(rows.select(F.col("doc_id").alias("gone")).distinct())
    return keyed.join(_growing(gone), F.col(ROW) == F.col("gone"), "left_anti").select(f"{DOC}.*")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, row by row. A label holds for all rows of its id.

    Null and empty texts go, as they have too few words; very long ones are judged whole. Rows
    of null id have no label, repeated rows are judged alike.
    """
    keyed = _keyed(docs)
    good = settle(table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").cast("long").alias("good")).distinct())
    labels = keyed.join(good, F.col(f"{DOC}.doc_id").cast("long") == F.col("good"), "left_semi").select(F.col(ROW).alias("doc_id"), F.lit(1).alias("quality"))
    return _without(keyed, quality_rules.judge(_by_row(keyed), labels).where("not kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest id, or the first row where ids are null or repeated.

    Null and empty texts have no duplicates and stay; very long texts are compared whole.
    """
    keyed = _keyed(docs)
    return _without(keyed, near_dup.near_duplicates(_by_row(keyed)).where("not kept"))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no copy of a test item, row by row. Null and empty texts stay; very long ones are searched whole."""
    keyed = _keyed(docs)
    return _without(keyed, decontaminate.contaminated(_by_row(keyed), table(spark, sf_dir, "benchmark")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes its words, to the nearest whole number, row by row.

    Documents without words take nothing and go; rows of null source are one source, the last.
    """
    keyed = _keyed(docs)
    taken = mixing.mix(_by_row(keyed)).select(F.col("doc_id").alias("row_taken"), F.floor(F.try_divide(F.col("taken"), F.col("size")) + 0.5).cast("int").alias("n_taken"))
    taken = settle(taken.where("n_taken > 0"))
    out = keyed.join(_growing(taken), F.col(ROW) == F.col("row_taken"))
    return out.select(DOC, F.explode(F.sequence(F.lit(1), F.col("n_taken")))).select(f"{DOC}.*")


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's shard and its slot there. Null texts count as empty; repeated rows are placed one by one."""
    return sharding.shard(docs)


STAGES = [("quality rules", quality), ("near-duplicates", near_duplicates), ("decontamination", benchmark), ("mixing", mix), ("sharding", shards)]

#: Word shingles, alignment and certified cutoffs have no SQL form; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; a stage's own tables are deleted as soon as its result is written."""
    docs, last = table(spark, sf_dir, "documents"), mark()
    for _, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir))
        release(last, mark() - 1)
        last = max(0, mark() - 1)
    return docs
