"""Operator 10 [native]: shards of near equal bytes by sampled splitters.

Records are ordered by (hash of the text, doc_id), so that equal texts lie side by side. A
size-weighted sample of keys gives quantile boundaries of many fine ranges; records go to their
range; a range that turns out overfull is subdivided by a hash of the text, and a text that
alone overfills a part by a hash of the id. Exact bytes of the parts, summed in order, place
every record on one line, and shard boundaries cut that line. A sample that is off only makes
ranges uneven; the shards stay exact.

Equal texts stay together unless they are more than a shard holds. Groups of over a hundredth
of a shard (there are at most 100 for each shard) are dealt to the shards first, the largest
first, each to the emptiest; the line of all others then fills the shards up. A smaller group
on a boundary goes to the side of its middle. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .store import settle

SHARDS = 16
#: Fine ranges, and expected keys in the sample; both fixed, whatever the size of the data.
RANGES, SAMPLE = 512, 16384
#: Groups of equal texts of more than this part of a shard are dealt whole, before all others.
LARGE = 100
_LOWEST = -(1 << 63)


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("h"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOWEST)).alias("id"),
    )


def splitters(keyed: DataFrame, total: int, ranges: int = RANGES, sample: int = SAMPLE) -> list[tuple[int, int]]:
    """At most ranges - 1 boundary keys in order: weighted quantiles of a size-weighted sample of keys.

    A record is drawn with probability size * sample / total, decided by a hash of its key, so
    reruns agree; a record larger than one sampling step is always drawn and weighs its size.
    """
    step = max(1.0, total / sample)
    draw = F.xxhash64(F.lit("draw"), "h", "id").bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))
    drawn = keyed.where(draw < F.col("size") / step).select("h", "id", F.greatest(F.lit(1.0), F.col("size") / step).alias("w"))
    order = W.orderBy("h", "id")
    part = F.floor(F.sum("w").over(order.rowsBetween(W.unboundedPreceding, -1)) * ranges / F.sum("w").over(W.partitionBy()))
    cut = drawn.withColumn("part", F.coalesce(part, F.lit(0))).where("part > 0").groupBy("part").agg(F.min(F.struct("h", "id")).alias("key"))
    return sorted({(r["key"]["h"], r["key"]["id"]) for r in cut.select("key").collect()})  # fewer than `ranges` rows


def range_of(bounds: list[tuple[int, int]]) -> Column:
    """The number of boundaries not above the record's key, found in two steps of a square root's length."""
    if not bounds:
        return F.lit(0)
    width = max(1, int(len(bounds) ** 0.5))

    def upto(h: Column, i: Column) -> Column:
        return F.size(
            F.filter(F.arrays_zip(h.alias("h"), i.alias("id")), lambda b: (F.col("h") > b["h"]) | ((F.col("h") == b["h"]) & (F.col("id") >= b["id"]))),
        )

    heads = bounds[::width]
    coarse = upto(F.lit([b[0] for b in heads]), F.lit([b[1] for b in heads]))
    rest = [bounds[k + 1 : k + width] for k in range(0, len(bounds), width)]
    within = F.when(
        coarse > 0,
        upto(F.element_at(F.array(*[F.lit([b[0] for b in r] or [0]) for r in rest]), coarse), F.element_at(F.array(*[F.lit([b[1] for b in r] or [0]) for r in rest]), coarse)),
    ).otherwise(0)
    # a last row without boundaries holds one filler, which is left out here
    full = F.element_at(F.lit([len(r) for r in rest]), F.greatest(coarse, F.lit(1)))
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * width + 1 + F.least(within, full))


def dealt(groups: list[tuple[int, int]], total: int, shards: int) -> tuple[dict[int, int], list[int]]:
    """The shard of each of the large groups (h, bytes), and the bytes that each shard has left for others."""
    load, to = [0] * shards, {}
    for h, size in sorted(groups, key=lambda g: (-g[1], g[0])):
        least = min(range(shards), key=lambda k: (load[k], k))
        to[h] = least
        load[least] += size
    rest = total - sum(load)
    # filled up to one level; a shard above it takes nothing more
    level, order = 0, sorted(load)
    for k in range(1, shards + 1):
        level = (rest + sum(order[:k])) / k
        if k == shards or level <= order[k]:
            break
    return to, [max(0, round(level - x)) for x in load]


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row, by law `bytes`.

    size is the UTF-8 length plus 1; shard sizes differ by a hundredth, or by one record if that
    is larger. Equal texts share a shard; only a group that is larger than a shard spreads over
    several. Null texts count as empty, null ids come first; repeated rows are placed one by one
    (equal rows may swap slots between themselves). A very long text is a large group of its own.
    Other columns are ignored; an empty table gives no rows. grown_shard is null: the law isn't `key`.
    """
    keyed = settle(_keyed(docs))
    sums = keyed.agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).first()
    total, rows = sums["bytes"] or 0, sums["rows"]
    full = max(1, 2 * rows // RANGES)
    share = total / shards
    texts = settle(
        keyed.groupBy("h").agg(F.sum("size").alias("b"), F.count("*").alias("n")).where((F.col("b") > share / LARGE) | (F.col("n") > full)),
    )
    large = texts.where((F.col("b") > share / LARGE) & ((F.col("b") <= share) | (F.col("n") == 1))).select("h", "b").collect()  # at most LARGE rows for each shard
    to, left = dealt([(r["h"], r["b"]) for r in large], total, shards)
    owner = keyed.sparkSession.createDataFrame(list(to.items()), "h long, owner int")
    # texts of more rows than a part should have, or of more bytes than a shard: at most RANGES / 2 and a row for each shard
    hot = texts.where((F.col("n") > full) | ((F.col("b") > share) & (F.col("n") > 1))).select("h", F.ceil(F.col("n") / F.lit(full)).alias("subs"))
    placed = keyed.join(F.broadcast(owner), "h", "left").join(F.broadcast(hot), "h", "left")
    placed = placed.withColumn("owner", F.coalesce("owner", F.lit(shards))).withColumn("range", range_of(splitters(keyed, total)))
    ranges = placed.where("subs is null").groupBy("range").agg(F.ceil(F.count("*") / F.lit(full)).alias("parts"))  # at most RANGES rows
    placed = placed.join(F.broadcast(ranges), "range", "left")
    # a hot text is a part of its own, before the others of its range
    placed = placed.withColumn("part", F.when(F.col("subs").isNotNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64("h"), F.col("parts"))))
    placed = placed.withColumn("alone", F.when(F.col("subs").isNotNull(), F.col("h"))).withColumn(
        "sub",
        F.when(F.col("subs").isNotNull(), F.pmod(F.xxhash64("id", F.lit("sub")), F.col("subs"))).otherwise(0),
    )
    placed = placed.drop("parts", "subs")
    cell = ["owner", "range", "part", "alone", "sub"]
    before = W.orderBy(*cell).rowsBetween(W.unboundedPreceding, -1)
    cells = placed.groupBy(*cell).agg(F.sum("size").alias("b"), F.count("*").alias("n"))  # at most a few times RANGES + LARGE * shards
    others = F.when(F.col("owner") == shards, F.col("b")).otherwise(0)
    cells = cells.select(
        *cell,
        F.coalesce(F.sum(others).over(before), F.lit(0)).alias("b0"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"),
    )
    cells = cells.select(*[F.col(c).alias(f"cell_{c}") for c in cell], "b0", "n0")
    line = W.partitionBy(*cell).orderBy("h", "id", "text_crc32", "size")
    inner, text = line.rowsBetween(W.unboundedPreceding, -1), W.partitionBy(*cell, "h")
    placed = placed.withColumn("inner", F.coalesce(F.sum("size").over(inner), F.lit(0))).withColumn("rank", F.row_number().over(line) - 1)
    # all rows of a text that isn't hot stand where its middle is
    placed = placed.withColumn("begin", F.when(F.col("alone").isNull(), F.min("inner").over(text)).otherwise(F.col("inner")))
    placed = placed.withColumn("width", F.when(F.col("alone").isNull(), F.sum("size").over(text)).otherwise(F.col("size")))
    same = F.lit(True)
    for c in cell:
        same &= F.col(c).eqNullSafe(F.col(f"cell_{c}"))
    placed = placed.join(F.broadcast(cells), same).withColumn("rank", F.col("rank") + F.col("n0"))
    ends = [sum(left[: k + 1]) for k in range(shards)]
    middle = F.col("b0") + F.col("begin") + F.col("width") / 2
    at = F.least(F.size(F.filter(F.lit([float(e) for e in ends]), lambda e: middle >= e)), F.lit(shards - 1))
    placed = placed.withColumn("shard", F.when(F.col("owner") < shards, F.col("owner")).otherwise(at).cast("int"))
    placed = settle(placed.select("doc_id", "size", "text_crc32", "shard", "rank", (F.col("owner") < shards).alias("large")))
    # large groups come first in a shard, then its stretch of the line
    first = placed.groupBy("shard").agg(
        F.min(F.when(F.col("large"), F.col("rank"))).alias("first_large"),
        F.min(F.when(~F.col("large"), F.col("rank"))).alias("first"),
        F.count_if("large").alias("n_large"),
    )
    slot = F.when(F.col("large"), F.col("rank") - F.col("first_large")).otherwise(F.col("rank") - F.col("first") + F.col("n_large"))
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        slot.cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
