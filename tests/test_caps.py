"""Queries read whole tables, not a first part of them."""

from caseloom.plans import catalogue


def test_per_source_cap_sees_all_sources(spark, tmp_path):
    rows = [(i, "hot", 10_000 - i) for i in range(2100)] + [(5000 + i, "rare", 9 - i) for i in range(3)]
    spark.createDataFrame(rows, "doc_id long, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.pos) for r in catalogue.QUERIES["per_source_cap"](spark, str(tmp_path)).collect()}
    assert got == {(i, i + 1) for i in range(13)} | {(5000, 2101), (5001, 2102)}
