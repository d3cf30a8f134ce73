"""Conversation structure repair (operator 13).

Turns that are blank, repeated or cut off are found in Spark: no text reaches the repair itself, only a
code of each turn. The repair is the cheapest one whose roles read ``(s?(ua)+)?`` by their initials. It is
found over retained subsequences: a retained turn is kept (0) or gets another role (``REROLE``; each
``CUT`` more if cut off); between two retained turns all others are deleted (``DELETE`` each, by prefix
sums) and the pair of their roles says how many turns are put in (``INSERT`` each). As deletions add up,
one running minimum for each role of the last retained turn prices every gap, so a turn costs a few
comparisons however far back its partner lies. Among the cheapest the least audit wins: audits that end in
different roles differ and none begins another, so their order is kept as a rank and never recomputed.

A conversation's turns pass through one task in order, as its repaired texts are one sequence; the
task keeps five bytes for each turn, and texts pass by one Arrow batch at a time. So a conversation that holds a
third of all rows needs time but not memory; repeated turns are found by another key (conversation, role, text).

Defined results: nulls in role and text read as one space, null conversations are one conversation, null
turns come first; turns of one number stand by role, then by the MD5 of their text, equal ones are
repeats; empty roles have no initial and fit nowhere; very long texts are hashed and searched in Spark; a
conversation without rows left has zeros and an empty audit; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import materialize

REROLE, DELETE, INSERT, CUT = 3, 4, 3, 3
WHITE = r"\x20\x09-\x0D"
START, S, U, A = range(4)  # the last retained turn: none, system, user, assistant
#: Turns to put in between two retained ones, by the last's role and the next one's (None: cannot follow).
PUT_IN = {(START, S): 0, (START, U): 0, (START, A): 1, (S, U): 0, (S, A): 1, (U, U): 1, (U, A): 0, (A, U): 0, (A, A): 1}
PUT_IN_AT_END = {START: 0, S: 2, U: 1, A: 0}
AFTER = {START: "user", S: "user", U: "assistant", A: "user"}  # the role of a turn put in, or given a role, there
KINDS = ["D", "K", "R", "IK", "IR"]
#: Codes of turns: role initial, and whether cut off; ``x`` must go.
CODES = {"s": (S, 0), "u": (U, 0), "a": (A, 0), "o": (None, 0), "S": (S, CUT), "U": (U, CUT), "A": (A, CUT), "O": (None, CUT), "x": (None, None)}
FAR = 1 << 60


class Repair:
    """The dynamic program of one conversation, fed turn by turn; keeps four bytes for each."""

    def __init__(self):
        self.least = [0, FAR, FAR, FAR]  # cheapest of the retained turns so far, less the price of deleting all turns so far
        self.rank = [0, 0, 0, 0]
        self.deleted = 0  # the prefix sum: deleting all turns so far
        self.steps = bytearray()

    def turn(self, code: str) -> None:
        role, cut = CODES[code]
        self.deleted += DELETE
        least, rank = self.least, self.rank
        # (price, rank of the audit before, kind) of each state; a state's own audit with one more deletion comes first
        best = [(least[r], rank[r], 0, r) for r in range(4)]
        if cut is not None:
            for (before, r), n in PUT_IN.items():
                if least[before] >= FAR or (r == S and role != S):
                    continue
                kind = 1 if role == r else 2
                price = least[before] + INSERT * n + (0 if kind == 1 else REROLE) + cut - DELETE
                found = (price, rank[before], kind + 2 * n, before)
                if self._less(found, best[r]):
                    best[r] = found
        self.least = [b[0] for b in best]
        # two audits differ before their last turn, or by their kind alone
        order = sorted(range(4), key=lambda r: (best[r][1], KINDS[best[r][2]]))
        for place, r in enumerate(order):
            self.rank[r] = place
        for b in best:
            self.steps.append(b[3] << 3 | b[2])

    @staticmethod
    def _less(x: tuple, y: tuple) -> bool:
        return (x[0], x[1], KINDS[x[2]]) < (y[0], y[1], KINDS[y[2]])

    def end(self) -> tuple[int, str]:
        """(cost, audit)"""
        _, _, state = min((self.least[r] + INSERT * PUT_IN_AT_END[r], self.rank[r], r) for r in range(4))
        cost = self.least[state] + INSERT * PUT_IN_AT_END[state] + self.deleted
        out = ["I" * PUT_IN_AT_END[state]]
        for at in range(len(self.steps) - 4, -1, -4):
            step = self.steps[at + state]
            out.append(KINDS[step & 7])
            state = step >> 3
        return cost, "".join(reversed(out))


@lru_cache(maxsize=65536)
def repair(codes: str) -> tuple[int, str]:
    """(cost, audit) of a short conversation, given as a string of codes."""
    found = Repair()
    for c in codes:
        found.turn(c)
    return found.end()


REMEMBERED = 64  # turns up to which conversations of the same codes are solved once


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (conv, live, code, initial, turn, fault) -> a row for each conversation."""
    names = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    conv, first, done = None, True, []

    def new():
        return {"codes": [], "long": None, "lo": None, "hi": None, "turns": 0, "last": None, "n": [0, 0, 0, 0], "initial": None}

    def close(c, at):
        gaps = at["hi"] - at["lo"] + 1 - at["turns"] if at["turns"] else 0
        if at["long"] is not None:
            for x in at["codes"]:
                at["long"].turn(x)
        cost, audit = at["long"].end() if at["long"] is not None else repair("".join(at["codes"]))
        done.append((c, gaps, *at["n"], cost, audit))

    def flush():
        columns = list(zip(*done)) if done else [[] for _ in names]
        kinds = [pa.string(), *[pa.int64()] * 6, pa.string()]
        out = pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)
        done.clear()
        return out

    at = new()
    for b in batches:
        for c, live, code, initial, turn, fault in zip(*(b.column(x).to_pylist() for x in ("conv", "live", "code", "initial", "turn", "fault"))):
            if first or c != conv:
                if not first:
                    close(conv, at)
                conv, first, at = c, False, new()
            if not live:
                continue
            if turn is not None and turn != at["last"]:
                at["lo"] = turn if at["lo"] is None else at["lo"]
                at["hi"] = at["last"] = turn
                at["turns"] += 1
            if fault:
                at["n"][fault - 1] += 1
            if at["initial"] is not None and at["initial"] + initial not in ("su", "ua", "au"):
                at["n"][3] += 1
            at["initial"] = initial
            at["codes"].append(code)
            if len(at["codes"]) > REMEMBERED:
                at["long"] = at["long"] or Repair()
                for x in at["codes"]:
                    at["long"].turn(x)
                at["codes"].clear()
        yield flush()
    if not first:
        close(conv, at)
    yield flush()


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows, before those of each conversation one with its audit -> repaired turns in order."""
    out, held = [], 0

    def flush():
        columns = list(zip(*out)) if out else [[]] * 5
        made = pa.record_batch([pa.array(c, k) for c, k in zip(columns, [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()])], names=["conv", "position", "role", "text", "edit"])
        out.clear()
        return made

    conv = audit = None
    place = position = last = 0
    state = START

    def put_in():
        nonlocal place, position, state
        while place < len(audit) and audit[place] == "I":
            role = AFTER[state]
            out.append((conv, position, role, "", "I"))
            state, place, position = (U if role == "user" else A), place + 1, position + 1

    for b in batches:
        for c, is_audit, role, text in zip(b.column("conv"), b.column("audited"), b.column("role"), b.column("text")):
            if is_audit.as_py():
                conv, audit, place, position, state = c.as_py(), text.as_py(), 0, 0, START
                last = len(audit.rstrip("I"))
                continue
            edit = audit[place]
            if edit == "I":
                put_in()
                edit = audit[place]
            place += 1
            if edit != "D":
                kept = role.as_py() if edit == "K" else AFTER[state]
                said = text.as_py()
                out.append((conv, position, kept, said, edit))
                held += len(said)
                state, position = {"s": S, "u": U, "a": A}[kept[:1]], position + 1
            if place == last:
                put_in()
            if len(out) >= 2000 or held > 1 << 22:
                held = 0
                yield flush()
    yield flush()


def _digest() -> Column:
    return F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"))


def faults(turns: DataFrame) -> DataFrame:
    """conv, live, turn, role, digest, again, code, initial, fault (0 none, 1 blank, 2 duplicate, 3 truncated).

    turns: conv (string, not null), live, turn, role, text (not null); rows that are not live only say that the conversation exists.
    """
    blank = ~F.col("text").rlike(f"[^{WHITE}]")
    rows = turns.select("conv", "live", "turn", "role", blank.alias("blank"), F.col("text").rlike(f"[.!?][{WHITE}]*\\z").alias("ended"), _digest().alias("digest"))
    w = W.partitionBy("conv", "live", "digest").orderBy(F.col("turn").asc_nulls_first())
    rows = rows.withColumn("again", F.row_number().over(w) > 1)
    fault = F.when(~F.col("live"), 0).when(F.col("blank"), 1).when(F.col("again"), 2).when(~F.col("ended"), 3).otherwise(0)
    initial = F.substring("role", 1, 1)
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    code = F.when(fault.isin(1, 2), "x").when(fault == 3, F.upper(known)).otherwise(known)
    return rows.select("conv", "live", "turn", "role", "digest", "again", fault.alias("fault"), code.alias("code"), initial.alias("initial"))


def audits(turns: DataFrame) -> DataFrame:
    """conv, gaps, blank, duplicate, truncated, illegal, cost, audit: one row for each conversation."""
    rows = faults(turns).repartition("conv").sortWithinPartitions("conv", "turn", "role", "digest", "again")
    return rows.select("conv", "live", "code", "initial", "turn", "fault").mapInArrow(_solve, "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


def repaired(turns: DataFrame, solved: DataFrame) -> DataFrame:
    """conv, position, role, text, edit (K kept, R other role, I put in): the repaired turns, each conversation in order in one partition."""
    rows = turns.filter("live").select("conv", F.lit(False).alias("audited"), "turn", "role", _digest().alias("digest"), "text")
    first = solved.select("conv", F.lit(True).alias("audited"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("digest"), F.col("audit").alias("text"))
    both = first.unionByName(rows).repartition("conv").sortWithinPartitions("conv", F.desc("audited"), "turn", "role", "digest")
    return both.select("conv", "audited", "role", "text").mapInArrow(_apply, "conv string, position long, role string, text string, edit string")


def digests(repaired_turns: DataFrame) -> DataFrame:
    """conv, sha256 of ``role:text`` of all its turns, parted by newlines; each conversation's turns must stand in order in one partition."""

    def run(batches):
        conv, h = None, None
        for b in batches:
            convs, made = [], []
            for c, role, text in zip(b.column("conv"), b.column("role"), b.column("text")):
                c = c.as_py()
                if h is None or c != conv:
                    if h is not None:
                        convs.append(conv)
                        made.append(h.hexdigest())
                    conv, h = c, sha256()
                else:
                    h.update(b"\n")
                h.update(role.as_buffer())
                h.update(b":")
                h.update(text.as_buffer())
            yield pa.record_batch([pa.array(convs, pa.string()), pa.array(made, pa.string())], names=["conv", "sha256"])
        if h is not None:
            yield pa.record_batch([pa.array([conv], pa.string()), pa.array([h.hexdigest()], pa.string())], names=["conv", "sha256"])

    return repaired_turns.mapInArrow(run, "conv string, sha256 string")


def turns_of(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The columns that the repair reads, nulls of texts and roles as one space; conv: ``-`` for null, else ``=`` and the id."""
    name = F.when(F.col(conv).isNull(), "-").otherwise(F.concat(F.lit("="), F.col(conv).cast("string")))
    role_, text_ = (F.coalesce(F.col(c), F.lit(" ")) for c in (role, text))
    return rows.select(name.alias("conv"), F.lit(True).alias("live"), F.col(turn).cast("long").alias("turn"), role_.alias("role"), text_.alias("text"))


def damaged(turns: DataFrame) -> DataFrame:
    """turns_of after damage by crc32(``conv:turn``) % 20: 0 drops, 1 empties, 2 takes ``[.!?]`` out, 3 repeats, 4 makes the role user."""
    conv = F.when(F.col("conv") == "-", " ").otherwise(F.substring("conv", 2, 1 << 30))
    how = F.crc32(F.concat(conv, F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))) % 20
    copies = F.when(how == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    text = F.when(how == 1, "").when(how == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return turns.select("conv", (how != 0).alias("live"), "turn", F.when(how == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")
