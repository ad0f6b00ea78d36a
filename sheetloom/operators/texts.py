"""Rules on texts that repeat: each different text is parsed once, and its rows look the result up."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import settle

#: A text of more than one row in HOT is hot (so fewer than HOT texts are); its rows meet it in SALTS parts.
HOT, SALTS = 200, 64

Rule = Callable[[DataFrame], DataFrame]


def by_text(rows: DataFrame, rules: dict[str, tuple[str, Rule]], key: list[str]) -> DataFrame:
    """`rows` with a struct for each entry of `rules`: what its rule makes of the text in its column; null texts give null.

    A rule takes a table of different texts (text) and returns it with more columns. Each text is
    parsed once, however many rows have it. Rows meet the results by the text and its hash, those of hot texts and null texts also by a
    salt from `key`, so that a text which holds a third of all rows is not one task's. `rows` are read once
    for each rule and once more: settle them first.
    """
    out = rows
    for into, (column, rule) in rules.items():
        seen = settle(rows.select(F.col(column).alias("text")).where("text is not null").groupBy("text").agg(F.count("*").alias("n")))
        total = seen.agg(F.sum("n")).first()[0] or 0
        hashed = F.xxhash64("text")
        hot = [r[0] for r in seen.where(F.col("n") * HOT > total).select(hashed).collect()]  # fewer than HOT numbers
        made = rule(seen.select("text"))
        made = settle(made.select(F.struct(*[c for c in made.columns if c != "text"]).alias("made"), F.col("text").alias("made_text"), hashed.alias("made_hash")))
        salts = F.when(F.col("made_hash").isin(hot), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
        made = made.withColumn("made_salt", F.explode(salts))
        out = _looked_up(out, column, into, made, hot, key)
    return out


def _looked_up(rows: DataFrame, column: str, into: str, made: DataFrame, hot: list[int], key: list[str]) -> DataFrame:
    text, salt = F.col(column), F.pmod(F.xxhash64(*key), F.lit(SALTS)).cast("int")
    asked = rows.withColumns({"text_hash": F.xxhash64(column), "text_salt": F.when(text.isNull() | F.xxhash64(column).isin(hot), salt).otherwise(0)})
    same: Column = (F.col("text_hash") == F.col("made_hash")) & (F.col("text_salt") == F.col("made_salt")) & (text == F.col("made_text"))
    return asked.join(made, same, "left").select(*rows.columns, F.col("made").alias(into))
