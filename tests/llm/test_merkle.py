import hashlib
import zlib

from caseloom.llm import merkle, queries as Q

from ..conftest import SMALL


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(nodes, out):
    """Root of nodes; out[i]: siblings of node i, level by level, as (left, right) lists."""
    groups = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, held = [], []
        for a in range(0, len(nodes), 16):
            run = nodes[a : a + 16]
            for j in range(len(run)):
                for i in groups[a + j]:
                    out[i].append((run[:j], run[j + 1 :]))
            up.append(h(*run))
            held.append(sum(groups[a : a + 16], []))
        nodes, groups = up, held
    return nodes[0]


def plain(rows):
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: h(*map(enc, r))
    lower = lambda t: t if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    heads, ways = [], {}
    for s in sources:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        ways[s] = [[] for _ in by[s]]
        heads.append(tree([leaf(r) for r in by[s]], ways[s]))
    top = [[] for _ in sources]
    root = tree(heads, top)
    out = []
    for k, s in enumerate(sources):
        for r, way in zip(by[s], ways[s]):
            steps = way + top[k]
            other = leaf((*r[:4], lower(r[4]))) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else leaf(r)
            for a, b in steps:
                other = h(*a, other, *b)
            out.append((r[0], leaf(r), heads[k], root, h(*[x for a, b in steps for x in a + b]), other, other == root))
    return out


def same(got, rows):
    return sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, plain(rows)))


def test_query_equals_plain_tree(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select(*merkle.FIELDS).collect()]
    got = Q.op12_merkle_manifest(spark, SMALL).collect()
    assert same(got, rows)
    assert any(not r.verified for r in got) and any(r.verified for r in got)


def test_deep_trees_nulls_ties_and_repeats(spark, tmp_path):
    """With blocks of 16 the climb takes several rounds; with those of production one."""
    rows = [(i, "a", "en", 3, f"Text {i}") for i in range(300)] + [(i, f"s{i % 40:02}", None, None, None) for i in range(90)]
    rows += [(None, None, None, None, "Wörter" * 30_000), (5, None, "x", 1, ""), (5, None, "x", 1, ""), (5, None, "X", 1, "Z"), (7, "ä", "x", 1, "B"), (8, "", "x", 1, "B"), (8, "-", "x", 1, "B")]
    spark.createDataFrame([(*r, 9, "k", 2) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, place int, key string, n int").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    assert same(Q.op12_merkle_manifest(spark, str(tmp_path)).collect(), rows)
    want = {(r[0], *r[1:4], r[4]) for r in plain(rows)}
    got = merkle.manifest(spark.read.parquet(str(tmp_path / "documents.parquet")), "doc_id", "source", per=1).collect()
    assert {(r.key, r.leaf, r.subroot, r.root, hashlib.sha256(r.proof.encode()).hexdigest()) for r in got} == want
    assert len(got) == len(rows) and all(r.folded == r.root for r in got)


def test_no_rows_and_one_row(spark, tmp_path):
    kind = "doc_id long, source string, lang string, n_chars long, text string"
    for name, rows in (("none", []), ("one", [(1, "s", "en", 1, "A")])):
        spark.createDataFrame(rows, kind).write.parquet(str(tmp_path / name / "documents.parquet"))
        got = Q.op12_merkle_manifest(spark, str(tmp_path / name)).collect()
        assert len(got) == len(rows) and (not rows or same(got, rows))


def test_every_altered_row_is_found_and_its_proof_has_all_siblings(spark):
    docs = spark.createDataFrame([(i, "s", f"t{i}") for i in range(20)], "doc_id long, source string, text string")
    from pyspark.sql import functions as F

    bad = F.when(F.col("doc_id") == 3, merkle.leaf([F.col("doc_id"), F.col("source"), F.lit("other")]))
    got = {r.key: r for r in merkle.manifest(docs, "doc_id", "source", ("doc_id", "source", "text"), bad).collect()}
    assert [k for k, r in got.items() if r.folded != r.root] == [3]
    assert len(got[3].proof) == (15 + 1) * 64 and len(got[17].proof) == (3 + 1) * 64
