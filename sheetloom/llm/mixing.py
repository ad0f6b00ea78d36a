"""Operator 3: mixing sources to target weights by a low-discrepancy schedule.

Targets come from weights by water-filling. Every source is laid out in a shuffled order and cut
into blocks of equal tokens. Slots of the mix take the points frac((n + 1/2) * phi); a point
falls into a source's part of the cumulative weights, and the k-th slot of a source takes its
block k modulo the number of its blocks, so sources interleave evenly at every length. A source
that the points leave short of its quota gets the slots it lacks at the end of the schedule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .store import settle
from .words import WORD

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
#: Blocks of the whole corpus, about, and of each source at least; a block has one token at least.
#: Targets are met to half a block, so to 1 part in 2 * OWN_BLOCKS of a source, or to half a token.
BLOCKS, OWN_BLOCKS = 1 << 18, 1 << 10
#: Parts of a source's shuffled order, parts of the unit interval, slots ranked together.
BUCKETS, CELLS, RUN = 1024, 4096, 4096
PHI = 0.6180339887498949


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words and a shuffling hash; null texts have no words."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64(F.lit("mix"), F.col("doc_id").cast("long"), text).alias("h"),
    )


def plan(sizes: DataFrame) -> DataFrame:
    """One row for each source: sid, source, source_size, target, blocks, quota, lo, hi.

    `sizes` is (source, source_size). lo and hi bound the source's part of the unit interval.
    """
    one = W.partitionBy()
    s = sizes.withColumn("sid", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())).cast("long"))
    weight = F.element_at(F.lit(list(WEIGHTS)), (F.pmod(F.col("sid") - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    s = s.withColumn("weight", weight.cast("double")).withColumn("cap", MOST * F.col("source_size").cast("double"))
    # filled in the order of cap / weight: a source is full if its level is not above that of all the rest
    order = W.orderBy(F.col("cap") / F.col("weight"), "sid")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    goal = SHARE * F.sum("source_size").over(one)
    level = (goal - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(one) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    s = s.withColumn("level", level).withColumn("rank", F.row_number().over(order))
    open_ = F.min(F.when(F.col("cap") / F.col("weight") > F.col("level"), F.struct("rank", "level"))).over(one)["level"]
    s = s.withColumn("target", F.coalesce(F.least(F.col("cap"), F.col("weight") * open_), F.col("cap")))
    block = F.ceil(F.sum("source_size").over(one) / BLOCKS)
    s = s.withColumn("blocks", F.least("source_size", F.greatest(F.lit(OWN_BLOCKS), F.rint(F.try_divide("source_size", block)).cast("long"))))
    s = s.withColumn("quota", F.when(F.col("blocks") > 0, F.rint(F.col("target") * F.col("blocks") / F.col("source_size")).cast("long")).otherwise(0))
    upto = F.sum("quota").over(W.orderBy("sid"))
    slots = F.sum("quota").over(one)
    return s.select(
        "sid",
        "source",
        "source_size",
        "target",
        "blocks",
        "quota",
        slots.alias("slots"),
        F.try_divide(upto - F.col("quota"), slots).alias("lo"),
        F.try_divide(upto, slots).alias("hi"),
    )


def schedule(sources: DataFrame) -> DataFrame:
    """The mix in order: slot, sid, rank of the slot in its source, pass, block.

    A source's points run ahead of or behind its part by a few. Each source stops at its quota;
    ranks that no point gave come after the last point, so every quota is met.
    """
    spark = sources.sparkSession
    slots = sources.agg(F.max("slots").alias("n")).first()["n"] or 0
    points = spark.range(slots).withColumnRenamed("id", "slot")
    points = points.withColumn("u", F.pmod((F.col("slot") + 0.5) * F.lit(PHI), F.lit(1.0))).withColumn("cell", F.floor(F.col("u") * CELLS))
    parts = sources.where("quota > 0").withColumn(
        "cell",
        F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1)))),
    )
    at = points.join(settle(parts.select("cell", "sid", "lo", "hi", "blocks", "quota")), "cell").where("u >= lo and u < hi")
    at = at.withColumn("run", F.expr(f"slot div {RUN}"))
    counts = at.groupBy("sid", "run").agg(F.count("*").alias("n"))
    counts = counts.select(
        "sid",
        "run",
        F.coalesce(F.sum("n").over(W.partitionBy("sid").orderBy("run").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("n0"),
    )
    at = at.withColumn("rank", F.row_number().over(W.partitionBy("sid", "run").orderBy("slot")) - 1).join(counts, ["sid", "run"])
    at = at.withColumn("rank", F.col("rank") + F.col("n0")).where("rank < quota").select("slot", "sid", "rank", "blocks")
    given = at.groupBy("sid").agg(F.count("*").alias("n"))
    short = sources.join(given, "sid", "left").withColumn("n", F.coalesce("n", F.lit(0))).where("n < quota")
    late = short.select("sid", "blocks", F.explode(F.expr("sequence(n, quota - 1)")).alias("rank"))
    at = at.unionByName(late.select((F.lit(slots) + F.col("rank")).alias("slot"), "sid", "rank", "blocks"))
    return at.select("slot", "sid", "rank", F.expr("rank div blocks").alias("pass"), F.pmod("rank", "blocks").alias("block"))


def pieces(docs: DataFrame) -> DataFrame:
    """The blocks' contents: sid, block, doc_id, size, begin of the document in its source, words of it in the block.

    `docs` is (doc_id, size, h, sid, source_size, blocks). Offsets are two-level sums over parts
    of the shuffled order, so no source is gathered in one place.
    """
    docs = docs.where("size > 0").withColumn("bucket", F.pmod("h", F.lit(BUCKETS)))
    sums = docs.groupBy("sid", "bucket").agg(F.sum("size").alias("n"))
    sums = sums.select(
        "sid",
        "bucket",
        F.coalesce(F.sum("n").over(W.partitionBy("sid").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("n0"),
    )
    inner = F.sum("size").over(W.partitionBy("sid", "bucket").orderBy("h", "doc_id").rowsBetween(W.unboundedPreceding, -1))
    docs = docs.withColumn("inner", F.coalesce(inner, F.lit(0))).join(sums, ["sid", "bucket"])
    docs = docs.withColumn("begin", F.col("n0") + F.col("inner")).withColumn("end", F.expr("begin + size"))
    docs = docs.withColumn("block", F.explode(F.expr("sequence(((begin + 1) * blocks - 1) div source_size, (end * blocks - 1) div source_size)")))
    return docs.select(
        "sid",
        "block",
        "doc_id",
        "size",
        "begin",
        F.expr("least(end, (block + 1) * source_size div blocks) - greatest(begin, block * source_size div blocks)").alias("words"),
    )


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row.

    Sources weigh 5, 2, 1 in turn by code point, null last, and share 150 % of all words; a
    source gets at most twice its words. taken counts repeats. One row for each input row;
    repeated rows are mixed one by one. Documents without words take nothing, a source without
    words has target 0, an empty table gives no rows. A very long text is spread over the blocks
    that it covers. Other columns are ignored. Reruns agree.
    """
    found = settle(sized(docs))
    sources = settle(plan(found.groupBy("source").agg(F.sum("size").alias("source_size"))))
    found = found.join(sources.select(F.col("source").alias("s"), "sid", "source_size", "blocks"), F.col("source").eqNullSafe(F.col("s")))
    times = schedule(sources).groupBy("sid", "block").agg(F.count("*").alias("times"))
    taken = pieces(found).join(times, ["sid", "block"], "left").groupBy("sid", "begin", "doc_id", "size").agg(
        F.sum(F.col("words") * F.coalesce("times", F.lit(0))).alias("taken"),
    )
    out = taken.select("doc_id", "size", "sid", "taken").unionByName(
        found.where("size = 0").select("doc_id", "size", "sid", F.lit(0).cast("long").alias("taken")),
    )
    return out.join(sources.select("sid", "source_size", "target"), "sid").select("doc_id", "size", "source_size", "target", "taken")
