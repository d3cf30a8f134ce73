"""Merkle dataset manifest (operator 12).

Leaves are digests of rows, computed by Spark. Of each group (source) they stand in the order of their
key; every ``FANOUT`` consecutive nodes of a level become the SHA-256 of their 64 hex characters each,
the last run of a level even if it holds one, until one node remains. The subroots of the groups, in the
order of the groups, are the leaves of one more such tree; what remains is the root.

Aligned blocks of ``FANOUT ** LEVELS`` nodes are rows: a task lays their digests out as one contiguous
matrix of 64-byte rows, reshapes each level by the fanout and hashes its rows; siblings are slices of
a level at index arithmetic's offsets. A block gives one node to the next round, so a group of any size
is spread over tasks, and a round divides the rows by 4,096. On the way down each block gets, once, the
siblings of its way to the root; its leaves add their own.

Defined results: nulls are ``-`` in a leaf; a null group is a group of its own, before all others; null
keys come before others, rows of one key stand in the order of their leaves, repeated rows are leaves of
their own; very long texts are hashed in Spark and never reach Python; a group of one leaf has that leaf as subroot, a
single group's subroot is the root; an empty table has no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.order import placed
from .common import materialize

FANOUT, LEVELS, HEX = 16, 3, 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: A way to the root is text: levels parted by ``|``, the siblings on the left and on the right of each by ``,``.
LEVEL, SIDE = "|", ","


def field(c: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, ``:`` and the value."""
    said = c.cast("string")
    return F.when(said.isNull(), "-").otherwise(F.concat(F.octet_length(said).cast("string"), F.lit(":"), said))


def leaf(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, fields)), 256)


def depth(n: int) -> int:
    """Levels above n leaves."""
    d = 0
    while n > 1:
        n, d = -(-n // FANOUT), d + 1
    return d


def parents(nodes: np.ndarray) -> np.ndarray:
    """The next level of a matrix of 64-byte rows."""
    full = len(nodes) // FANOUT
    runs = list(nodes[: full * FANOUT].reshape(full, FANOUT * HEX))
    if len(nodes) > full * FANOUT:
        runs.append(nodes[full * FANOUT :].reshape(-1))
    return np.frombuffer("".join(sha256(r).hexdigest() for r in runs).encode(), np.uint8).reshape(-1, HEX)


def levels(leaves: np.ndarray, up: int) -> list[np.ndarray]:
    out = [leaves]
    for _ in range(up):
        out.append(parents(out[-1]))
    return out


def way(raw: list[bytes], i: int) -> list[tuple[bytes, bytes]]:
    """(left, right) siblings of leaf i, level by level; raw: the bytes of the levels below the last."""
    out = []
    for level in raw:
        at, begin = i * HEX, i // FANOUT * FANOUT * HEX
        out.append((level[begin:at], level[at + HEX : begin + FANOUT * HEX]))
        i //= FANOUT
    return out


def fold(node: bytes, steps: list[tuple[bytes, bytes]]) -> bytes:
    """The root that a leaf and its siblings give."""
    for left, right in steps:
        node = sha256(left + node + right).hexdigest().encode()
    return node


def _matrix(items: pa.ListScalar | pa.StructArray, name: str) -> np.ndarray:
    column = items.field(name)
    return np.frombuffer("".join(column.to_pylist()).encode(), np.uint8).reshape(-1, HEX)


def _above(said: str) -> list[tuple[bytes, bytes]]:
    return [tuple(x.encode().split(SIDE.encode())) for x in said.split(LEVEL)] if said else []


def _said(steps: list[tuple[bytes, bytes]]) -> str:
    return LEVEL.join(f"{a.decode()}{SIDE}{b.decode()}" for a, b in steps)


def _roots(batches: Iterator[pa.RecordBatch], per: int) -> Iterator[pa.RecordBatch]:
    """Each block's node: as many levels up as the block, or its group, has."""
    for b in batches:
        made = []
        for items, n in zip(b.column("items"), b.column("n").to_pylist()):
            made.append(levels(_matrix(items.values, "node"), min(per, depth(n)))[-1].tobytes().decode())
        yield pa.record_batch([b.column("grp"), b.column("block"), pa.array(made, pa.string()), pa.array([-(-n // FANOUT**per) for n in b.column("n").to_pylist()], pa.int64())], names=["grp", "place", "node", "n"])


def _ways(batches: Iterator[pa.RecordBatch], per: int) -> Iterator[pa.RecordBatch]:
    """Of each node of each block, the siblings up to the root of its group."""
    for b in batches:
        for grp, items, n, above, top in zip(*(b.column(c) for c in ("grp", "items", "n", "above", "top"))):
            raw = [x.tobytes() for x in levels(_matrix(items.values, "node"), min(per, depth(n.as_py())))[:-1]]
            rest, count = above.as_py(), len(items.values)
            said = [LEVEL.join(x for x in (_said(way(raw, i)), rest) if x) for i in range(count)]
            yield pa.record_batch([pa.array([grp.as_py()] * count, pa.string()), items.values.field("place"), pa.array(said, pa.string()), pa.array([top.as_py()] * count, pa.string())], names=["grp", "place", "way", "top"])


def _proofs(batches: Iterator[pa.RecordBatch], per: int) -> Iterator[pa.RecordBatch]:
    """Of each leaf, its siblings up to the root of the roots, and the root that its altered self gives with them."""
    names = ["grp", "key", "leaf", "proof", "folded"]
    for b in batches:
        for grp, items, n, above in zip(*(b.column(c) for c in ("grp", "items", "n", "above"))):
            raw = [x.tobytes() for x in levels(_matrix(items.values, "node"), min(per, depth(n.as_py())))[:-1]]
            rest = _above(above.as_py())
            tail = b"".join(x + y for x, y in rest).decode()
            nodes, altered = items.values.field("node").to_pylist(), items.values.field("altered").to_pylist()
            for at in range(0, len(nodes), 512):  # proofs are long: a batch holds those of 512 leaves
                proofs, folded = [], []
                for i in range(at, min(at + 512, len(nodes))):
                    own = way(raw, i)
                    proofs.append(b"".join(x + y for x, y in own).decode() + tail)
                    folded.append(fold((altered[i] or nodes[i]).encode(), own + rest).decode())
                size = len(proofs)
                yield pa.record_batch([pa.array([grp.as_py()] * size, pa.string()), items.values.field("key").slice(at, size), pa.array(nodes[at : at + size]), pa.array(proofs, pa.string()), pa.array(folded, pa.string())], names=names)


def _blocks(nodes: DataFrame, per: int, *rest: str) -> DataFrame:
    """grp, block, n, items: of each aligned block its nodes in order."""
    size = F.lit(FANOUT**per)
    held = nodes.groupBy("grp", F.floor(F.col("place") / size).cast("long").alias("block"), "n")
    return held.agg(F.array_sort(F.collect_list(F.struct("place", "node", *rest))).alias("items"))


def _climb(nodes: DataFrame, per: int) -> tuple[list[DataFrame], DataFrame]:
    """Blocks of each round, lowest first, and the last round's nodes, one for each group. nodes: grp, place, node, n."""
    rounds = []
    while nodes.agg(F.max("n")).first()[0] or not rounds:
        rounds.append(materialize(_blocks(nodes, per, *[c for c in nodes.columns if c not in ("grp", "place", "node", "n")]), "merkle-blocks"))
        nodes = materialize(rounds[-1].mapInArrow(lambda b: _roots(b, per), "grp string, place long, node string, n long"), "merkle-nodes")
        if (nodes.agg(F.max("n")).first()[0] or 1) <= 1:
            break
    return rounds, nodes


def _descend(rounds: list[DataFrame], tops: DataFrame, per: int) -> DataFrame:
    """grp, place, way, top for the nodes of the round below the given ones (of the lowest given round's own nodes)."""
    known = tops.select("grp", F.lit(0).cast("long").alias("place"), F.lit("").alias("way"), F.col("node").alias("top"))
    for blocks in reversed(rounds):
        held = blocks.join(known.select("grp", F.col("place").alias("block"), F.col("way").alias("above"), "top"), ["grp", "block"])
        known = materialize(held.select("grp", "n", "above", "top", F.transform("items", lambda x: F.struct(x["place"].alias("place"), x["node"].alias("node"))).alias("items")).mapInArrow(lambda b: _ways(b, per), "grp string, place long, way string, top string"), "merkle-ways")
    return known


def manifest(rows: DataFrame, key: str, group: str, fields: tuple[str, ...] = FIELDS, altered: Column | None = None, per: int = LEVELS) -> DataFrame:
    """key, leaf, subroot, root, proof (siblings as one text), folded (the root that the leaf and its siblings give).

    altered: the digest of a row as someone else holds it, null where it is the same; then ``folded`` is the
    root that this digest and the original siblings give: it equals the root only if the row is the original.
    per: levels of a block.
    """
    grp = F.when(F.col(group).isNull(), "-").otherwise(F.concat(F.lit("="), F.col(group).cast("string")))  # in the order of the groups
    made = rows.select(grp.alias("grp"), F.col(key).alias("key"), leaf([F.col(c) for c in fields]).alias("node"), (altered if altered is not None else F.lit(None).cast("string")).alias("altered"))
    made = made.withColumn("row", F.monotonically_increasing_id())  # parts equal rows, of which there may be many
    leaves = materialize(made, "merkle-leaves")
    ordered = placed(leaves, [F.col("key").asc_nulls_first(), "node", "row"], ["grp"], total="n").drop("row")
    rounds, tops = _climb(ordered, per)
    # the tree over the subroots
    heads = placed(tops.select(F.col("grp").alias("source"), "node"), ["source"], total="n").withColumn("grp", F.lit("root"))
    upper, root = _climb(heads, per)
    over = _descend([u.withColumn("items", F.transform("items", lambda x: F.struct(x["place"].alias("place"), x["node"].alias("node")))) for u in upper], root, per)
    over = over.join(heads.select("source", "place", F.col("node").alias("subroot")), "place").select(F.col("source").alias("grp"), "subroot", F.col("way").alias("over"), F.col("top").alias("root"))
    # down from the subroots to the blocks of leaves
    known = _descend(rounds[1:], tops, per).select("grp", F.col("place").alias("block"), F.col("way").alias("within"))
    heads = over.select("grp", "subroot", "root", "over")
    above = F.concat("within", F.when((F.col("within") != "") & (F.col("over") != ""), LEVEL).otherwise(""), "over")
    lowest = rounds[0].join(known.join(heads, "grp").select("grp", "block", above.alias("above")), ["grp", "block"])
    kind = leaves.schema["key"].dataType.simpleString()
    proofs = lowest.select("grp", "n", "above", "items").mapInArrow(lambda b: _proofs(b, per), f"grp string, key {kind}, leaf string, proof string, folded string")
    return proofs.join(heads.drop("over"), "grp").select("key", "leaf", "subroot", "root", "proof", "folded")
