"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

BLOCK_SEARCH = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS c FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, e.vec_id, CAST(list_inner_product(q.c, e.c) AS BIGINT) AS score FROM v q JOIN v e ON e.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""


def crc32(text: str) -> str:
    """Unsigned CRC-32 of a text expression of one-byte characters: its table from the polynomial, folded over the bytes."""
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    table = "list_transform(range(256), lambda c: " + "list_reduce([c, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, y: " + step + "))"
    return f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split({text}, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda s, b: xor(s >> 8, ({table})[1 + (xor(s, b) & 255)])), 4294967295)"


DEPTH = 8  # levels said in SQL: enough for 16**8 rows of a source


def merkle() -> str:
    field = lambda c: f"coalesce(CAST(octet_length(encode(CAST({c} AS VARCHAR))) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
    text = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    head = " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars"))
    parts = [f"""d AS (SELECT row_number() OVER () AS id, doc_id, source, sha256({head} || {field("text")}) AS leaf, sha256({head} || {field(text)}) AS lower, {crc32("CAST(doc_id AS VARCHAR)")} % 5 = 0 AS tampered FROM documents),
a0 AS (SELECT *, coalesce('=' || source, '-') AS grp, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, id) - 1 AS place FROM d),
n0 AS (SELECT grp, place, leaf AS node FROM a0)"""]

    def climb(n: str, group: str) -> None:
        for k in range(DEPTH):
            parts.append(f"""{n}{k + 1} AS (SELECT {group}, place // 16 AS place, CASE WHEN max(size) > 1 THEN sha256(string_agg(node, '' ORDER BY place)) ELSE max(node) END AS node FROM (SELECT *, count(*) OVER (PARTITION BY {group}) AS size FROM {n}{k}) GROUP BY {group}, place // 16)""")
            run = f"PARTITION BY {group}, place // 16 ORDER BY place ROWS BETWEEN"
            parts.append(f"""{n}s{k} AS (SELECT {group}, place, coalesce(string_agg(node, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(node, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r, count(*) OVER (PARTITION BY {group}) > 1 AS more FROM {n}{k})""")

    climb("n", "grp")
    parts.append(f"m0 AS (SELECT 1 AS one, row_number() OVER (ORDER BY grp) - 1 AS place, node, grp FROM n{DEPTH})")
    climb("m", "one")
    steps = [f"n{k}" for k in range(DEPTH)] + [f"m{k}" for k in range(DEPTH)]
    folded = "CASE WHEN tampered THEN lower ELSE leaf END AS f0, '' AS p0"
    at = f"SELECT a0.doc_id, a0.leaf, n{DEPTH}.node AS subroot, m{DEPTH}.node AS root, a0.grp, a0.place, m0.place AS source_place, {folded} FROM a0 JOIN n{DEPTH} ON n{DEPTH}.grp = a0.grp JOIN m0 ON m0.grp = a0.grp CROSS JOIN m{DEPTH}"
    for i, s in enumerate(steps):
        own = f"s.grp = w.grp AND s.place = w.place // {16 ** int(s[1:])}" if s[0] == "n" else f"s.place = w.source_place // {16 ** int(s[1:])}"
        parts.append(f"w{i} AS ({at})")
        at = f"SELECT w.* EXCLUDE (f0, p0), CASE WHEN more THEN sha256(l || f0 || r) ELSE f0 END AS f0, p0 || CASE WHEN more THEN l || r ELSE '' END AS p0 FROM w{i} w JOIN {s[0]}s{s[1:]} s ON {own}"
    return "WITH " + ",\n".join(parts) + f",\nz AS ({at}) SELECT doc_id, leaf, subroot, root, sha256(p0) AS proof_sha256, f0 AS folded_root, f0 = root AS verified FROM z"


def oracle_sql() -> dict[str, str]:
    return {"op11_block_search": BLOCK_SEARCH, "op12_merkle_manifest": merkle()}
