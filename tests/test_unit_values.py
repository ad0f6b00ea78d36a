"""unit_values parses each different text once: no text rule is left to its rows."""

import duckdb

from sheetloom.jobs import queries

HERE = "/root/testdata/sf0.001"


def test_rows_look_texts_up(spark):
    made = queries.unit_values(spark, HERE)
    assert "regexp" not in made._jdf.queryExecution().optimizedPlan().toString().lower()
    con = duckdb.connect()
    for t in ("lineitem", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{HERE}/{t}.parquet'")
    told = con.execute(queries.SQL["unit_values"])
    at = [[c[0] for c in told.description].index(c) for c in made.columns]
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, made.collect())) == sorted(key([r[k] for k in at]) for r in told.fetchall())
