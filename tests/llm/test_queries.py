import importlib.util

import pytest

if importlib.util.find_spec("corpus_pipeline") is None:
    pytest.skip("no pipeline", allow_module_level=True)

import __spark_entry__
import corpus_pipeline
from caseloom.llm import queries as Q

SMALL = "/root/testdata/sf0.001"


def test_every_operator_is_registered():
    names = {n.split("_")[0] for n in __spark_entry__.queries() if n.startswith("op")}
    assert names == {f"op{i}" for i in range(1, 14)} and "pipeline" in __spark_entry__.queries()


def test_queries_equal_their_sql(spark):
    import duckdb

    from caseloom.llm.oracles import oracle_sql

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    for name, sql in oracle_sql().items():
        got, want = Q.queries()[name](spark, SMALL), con.execute(sql)
        columns = [c[0] for c in want.description]
        assert sorted(got.columns) == sorted(columns)
        assert sorted(tuple(r) for r in got.select(*columns).collect()) == sorted(want.fetchall()), name


def test_decontamination_equals_plain_search(spark):
    import re

    docs, items = (spark.read.parquet(f"{SMALL}/{n}.parquet").collect() for n in ("documents", "benchmark"))
    plain = lambda t: " ".join(re.findall(r"\w+", (t or "").lower()))
    want = {(d.doc_id, i.item_id) for d in docs for i in items if plain(i.text) in plain(d.text)}
    assert {(r.doc_id, r.item_id) for r in Q.op6_decontamination(spark, SMALL).collect()} == want


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.materialize(stage(spark, docs, SMALL), name)
        assert out.columns == docs.columns
        kept = {r.doc_id: r for r in out.collect()}
        assert set(kept) <= set(before) and len(kept) >= 0.8 * len(before), name
        if name != "personal_data":
            assert all(kept[i] == before[i] for i in kept)
        else:
            assert set(kept) == set(before)
        docs, before = out, kept
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == set(before)


def test_stages_take_nulls_repeats_and_clashing_columns(spark):
    """Every row is a document of its own: unlike texts without an id or of one id all stay, near copies once; other columns as they are."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, _text string, _id long, terms string, base string, score double, component_id long, _row int"
    quite = "quite another text about old boats and the sea"
    made = [(None, None), (None, "mail a@b.cc now"), (None, quite), (None, quite), (1, ""), (2, "one two three"), (2, "one two three"), (3, "w " * 20_000), (4, None), (5, "alpha beta gamma delta epsilon zeta"), (5, "words of a different kind stand here"), (6, quite)]
    rows = spark.createDataFrame([(i, t, None, "s", None, "x", 1, "t", "b", 0.5, 9, 1) for i, t in made], schema)
    want = sorted([(0, "mail <EMAIL> now"), (1, ""), (2, "one two three"), (3, "w " * 20_000), (5, "alpha beta gamma delta epsilon zeta"), (5, "words of a different kind stand here"), (6, quite)])
    for docs, expected in ((rows, want), (rows.limit(0), [])):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = corpus_pipeline.materialize(stage(spark, docs, SMALL), name)
            assert docs.columns == rows.columns, name
        kept = docs.collect()
        assert sorted((r.doc_id or 0, r.text) for r in kept) == expected
        assert all((r._text, r._id, r.terms, r.component_id, r._row) == ("x", 1, "t", 9, 1) for r in kept)
        pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
        assert {p.doc_id for p in pieces} == {r.doc_id for r in kept}


def test_toxic_and_leaked_rows_go_whatever_their_id(spark):
    """Of two texts of one id, and of rows without one, only the toxic or leaked ones go."""
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").orderBy("item_id").first().text
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    gone = docs.join(corpus_pipeline.toxicity(spark, docs, SMALL), "doc_id", "left_anti").first()
    mixed = docs.union(spark.createDataFrame([(None, gone.text if gone else "x"), (None, "clean words only"), (7, item), (None, f"before {item} after")], docs.schema))
    kept = corpus_pipeline.toxicity(spark, mixed, SMALL).collect()
    assert (None, "clean words only") in {(r.doc_id, r.text) for r in kept} and (not gone or gone.text not in {r.text for r in kept})
    kept = {(r.doc_id, r.text) for r in corpus_pipeline.decontamination(spark, mixed, SMALL).collect()}
    was = {(r.doc_id, r.text) for r in docs.filter("doc_id = 7").collect()}
    assert was <= kept and (7, item) not in kept and (None, f"before {item} after") not in kept


def test_stages_begin_with_the_heap_given_back(spark):
    """Every stage has the executors collect their garbage, so that their heaps don't grow from stage to stage."""
    collectors = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    whole = lambda: sum(c.getCollectionCount() for c in collectors if "Old" in c.getName() or "MarkSweep" in c.getName())
    few = spark.read.parquet(f"{SMALL}/documents.parquet").limit(20)
    for name, stage in [x for x in corpus_pipeline.STAGES if x[0] in ("decontamination", "personal_data")]:
        before = whole()
        stage(spark, few, SMALL)
        assert whole() > before, name


def test_texts_are_read_in_bounded_batches(spark):
    with corpus_pipeline.materialize.__globals__["small_batches"](spark):
        assert int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")) <= 1000
    assert int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")) > 1000
