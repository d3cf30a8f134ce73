"""Ties that columns leave open are settled as in the SQL."""

import datetime as dt

from caseloom.plans import catalogue


def test_first_of_lines_of_one_number_and_day_is_that_of_the_least_sentence(spark, tmp_path):
    import duckdb

    day = dt.date(1996, 10, 7)
    rows = [(1, 2, 3.0, "N", day), (1, 2, 28.0, "A", day), (2, 1, 9.0, "A", day), (2, 1, 9.0, "R", day), (2, 1, 9.0, "N", day), (3, 2, 1.0, "A", day), (3, 1, 50.0, "A", day), (4, 1, 2.0, "A", day), (4, 1, 10.0, "A", dt.date(1996, 2, 28))]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_quantity double, l_returnflag string, l_shipdate date").write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = dict(con.execute(catalogue.ORACLES["evidence_sentences"]).fetchall())
    got = {r.l_orderkey: r.sentence for r in catalogue.QUERIES["evidence_sentences"](spark, str(tmp_path)).collect()}
    assert got == want and "最高达28毫米" in got[1] and "五台" in got[2] and "最高达50毫米" in got[3] and "2月28日" in got[4]
