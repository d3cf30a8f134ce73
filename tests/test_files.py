from pyspark.sql import types as T

from caseloom.sources import files


def test_bad_files_and_elements_are_rows(spark, tmp_path):
    (tmp_path / "a.json").write_text('﻿[{"id": "1", "tags": ["x", "y"], "other": 1}, {"tags": []}, 7,\n {"id": "2"}]', encoding="utf-8")
    (tmp_path / "b.json").write_text('[{"id": "3"}', encoding="utf-8")
    (tmp_path / "c.json").write_text("", encoding="utf-8")
    (tmp_path / "d.json").write_text("[]", encoding="utf-8")
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("tags", T.ArrayType(T.StringType()))])
    good, bad = files.json_elements(spark, [str(tmp_path)], schema, "id")
    name = lambda f: f.rsplit("/", 1)[1]
    assert sorted((name(r.file), r.position, r.id) for r in good.collect()) == [("a.json", 0, "1"), ("a.json", 3, "2")]
    assert sorted((name(r.file), r.position or -1, r.error) for r in bad.collect()) == [("a.json", 1, "no such element"), ("a.json", 2, "no such element"), ("b.json", -1, "no JSON array")]
    assert sorted((r.term, r.id) for r in files.inverted(good, "id", "tags").collect()) == [("x", "1"), ("y", "1")]


def test_signatures_tell_changed_files(spark, tmp_path):
    import os

    for n in "abc":
        (tmp_path / f"{n}.json").write_text("[]")
    before = spark.createDataFrame(files.signatures(spark, [str(tmp_path)]).collect())
    (tmp_path / "a.json").write_text("[1]")
    os.utime(tmp_path / "b.json", (1, 1))
    (tmp_path / "c.json").rename(tmp_path / "d.json")
    got = {(r.file.rsplit("/", 1)[1], r.change) for r in files.changed(files.signatures(spark, [str(tmp_path)]), before).collect()}
    assert got == {("a.json", "changed"), ("b.json", "changed"), ("c.json", "gone"), ("d.json", "new")}


def test_absent_tables_are_empty(spark, tmp_path):
    spark.range(5).selectExpr("4 - id as k").write.parquet(str(tmp_path / "here.parquet"))
    found = files.snapshot(spark, str(tmp_path), {"here": ("k", "k long"), "not": ("k", "k long, v string")})
    assert [r.k for r in found["here"].collect()] == [0, 1, 2, 3, 4] and found["not"].collect() == [] and found["not"].columns == ["k", "v"]
