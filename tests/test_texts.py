import random

from pyspark.sql import functions as F

from sheetloom.functions.kv import parse_kv
from sheetloom.functions.units import parse_dimensions
from sheetloom.operators.grid import computed
from sheetloom.operators.products import dimension_text
from sheetloom.operators.texts import HOT, SALTS, by_text
from sheetloom.sources.store import settle

ROWS = "k int, spec string, size string"


def _rows(spark, n=1500, seed=3):
    r = random.Random(seed)
    texts = [f"SIZE: {a} X {b} {u}\nCOLOUR - c{a}" for a in range(1, 12) for b in (3, 70) for u in ("MM", "CM")] + ["", " ", "no pair", "KEY:  v", "Größe: 3"]
    specs = [None if k % 3 == 0 else "SIZE: 600 X 40 MM" if k % 3 == 1 else r.choice(texts) for k in range(n)]
    return settle(spark.createDataFrame([(k, t, r.choice(["30 X 40 MM", None, "7 cm", "x"])) for k, t in enumerate(specs)], ROWS))


def _facts(seen):
    def rule(texts):
        seen.append([r["text"] for r in texts.select("text").collect()])
        t = computed(texts, {"kv": parse_kv(F.col("text"))})
        return computed(t.withColumn("dim", dimension_text(F.col("kv"))), {"dims": parse_dimensions(F.col("dim"))})

    return rule


def _sizes(texts):
    return computed(texts, {"dims": parse_dimensions(F.col("text"))})


def test_each_text_is_parsed_once_and_all_rows_get_it(spark):
    rows, seen = _rows(spark), []
    got = by_text(rows, {"s": ("spec", _facts(seen)), "d": ("size", _sizes)}, ["k"])
    assert got.columns == ["k", "spec", "size", "s", "d"]
    assert sorted(seen[0]) == sorted({r["spec"] for r in rows.collect()} - {None})
    direct = computed(rows, {"kv": parse_kv(F.col("spec"))})
    direct = computed(direct.withColumn("dim", dimension_text(F.col("kv"))), {"dims": parse_dimensions(F.col("dim")), "sized": parse_dimensions(F.col("size"))})
    plain = {r["k"]: (r["kv"], r["dim"], r["dims"], r["sized"]) for r in direct.collect()}
    made = got.collect()
    assert len(made) == 1500 == len({r["k"] for r in made})
    for r in made:
        kv, dim, dims, sized = plain[r["k"]]
        assert r["s"] is None if r["spec"] is None else (r["s"]["kv"], r["s"]["dim"], r["s"]["dims"]) == (kv, dim, dims)
        assert r["d"] is None if r["size"] is None else r["d"]["dims"] == sized


def test_hot_and_null_texts_spread_over_tasks(spark, monkeypatch):
    from sheetloom.operators import texts

    asked = []
    whole = texts._looked_up

    def watched(rows, column, into, made, hot, key):
        asked.append((hot, made.groupBy("made_hash").agg(F.count("*").alias("n")).collect()))
        return whole(rows, column, into, made, hot, key)

    monkeypatch.setattr(texts, "_looked_up", watched)
    many = _rows(spark).select("k", "spec").unionByName(spark.range(20_000).select(F.col("id").cast("int").alias("k"), F.concat(F.lit("T: "), "id").alias("spec")))
    got = by_text(settle(many), {"s": ("spec", _facts([]))}, ["k"])
    assert got.count() == 21_500
    hot, parts = asked[0]
    assert len(hot) == 1 < HOT
    assert {r["n"] for r in parts if r["made_hash"] in hot} == {SALTS} and {r["n"] for r in parts if r["made_hash"] not in hot} == {1}


def test_no_rows_and_no_texts(spark):
    for rows, n in ((_rows(spark).limit(0), 0), (_rows(spark).withColumn("spec", F.lit(None).cast("string")), 1500)):
        got = by_text(settle(rows), {"s": ("spec", _sizes)}, ["k"])
        assert got.where("s is null").count() == got.count() == n
