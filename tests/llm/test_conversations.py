import hashlib
import itertools
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from caseloom.llm import conversations as C
from caseloom.llm import queries as Q

from ..conftest import SMALL

WORD = re.compile(r"[^\x20\x09-\x0D]")
GOOD = re.compile(r"(s?(ua)+)?\Z")


def plain_audit(codes):
    """By trying all edits of up to a few turns: (cost, audit), least cost, then least audit."""
    best = None
    per_turn = []
    for c in codes:
        role, cut = C.CODES[c]
        ways = [("D", "", 4)]
        if cut is not None:
            ways += [("K", c.lower(), cut)] if role is not None else []
            ways += [("R", r, 3 + cut) for r in "ua"]
        per_turn.append([("I" * n + w, "+" * n + out, 3 * n + cost) for w, out, cost in ways for n in range(3)])
    for choice in itertools.product(*per_turn, [("I" * n, "+" * n, 3 * n) for n in range(3)]):
        cost = sum(x[2] for x in choice)
        if best and cost > best[0]:
            continue
        slots = ["ua" if x == "+" else x for part in choice for x in part[1]]
        if any(GOOD.match("".join(p)) for p in itertools.product(*slots)):
            found = (cost, "".join(x[0] for x in choice))
            best = min(best or found, found)
    return best


@pytest.mark.parametrize("n", range(4))
def test_repair_is_the_least_of_all(n):
    for codes in itertools.product("suaoSUx" if n == 3 else list(C.CODES), repeat=n):
        assert C.repair("".join(codes)) == plain_audit(codes), codes


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="suaUAox", min_size=4, max_size=5))
def test_repair_of_longer_ones(codes):
    assert C.repair(codes) == plain_audit(codes)


def simple(rows):
    """The contract, said in Python, row by row; the cheapest edits by a memo over suffixes and outputs."""
    from functools import lru_cache

    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, [])
        how = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
        by[conv] += [(turn, "user" if how == 4 else role, text)] * (0 if how == 0 else 2 if how == 3 else 1)
    out = set()
    for conv, turns in by.items():
        key = lambda r: hashlib.md5(f"{len(r[1].encode())}:{r[1]}{r[2]}".encode()).hexdigest()
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], key(r)))
        n = {"blank": 0, "duplicate": 0, "truncated": 0}
        seen, marks = set(), []
        for _, role, text in turns:
            chars = WORD.findall(text)
            fault = "blank" if not chars else "duplicate" if (role, text) in seen else "truncated" if chars[-1] not in ".!?" else None
            seen.add((role, text))
            marks.append(fault)
            if fault:
                n[fault] += 1
        first = [r[1][:1] for r in turns]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(first))
        told = [t for t, _, _ in turns if t is not None]
        gaps = max(told) - min(told) + 1 - len(set(told)) if told else 0

        @lru_cache(None)
        def rest(i, state, budget=2):  # noqa: B023
            """(cost, audit, outputs) from turn i on; state: what was put out last."""
            ways = [(0, "", ())] if i == len(turns) and state in ("", "a") else []
            need = "a" if state == "u" else "u"
            if budget:
                c, a, o = rest(i, need, budget - 1)
                ways.append((c + 3, "I" + a, (({"u": "user", "a": "assistant"}[need], ""), *o)))
            if i < len(turns):
                _, role, text = turns[i]
                c, a, o = rest(i + 1, state)
                ways.append((c + 4, "D" + a, o))
                if marks[i] not in ("blank", "duplicate"):
                    cut = 3 * (marks[i] == "truncated")
                    c, a, o = rest(i + 1, need)
                    ways.append((c + 3 + cut, "R" + a, (({"u": "user", "a": "assistant"}[need], text), *o)))
                    if role[:1] == need or (role[:1] == "s" and state == "" and not any(False for _ in ())):
                        c, a, o = rest(i + 1, role[:1])
                        ways.append((c + cut, "K" + a, ((role, text), *o)))
            return min(ways, default=(10**9, "", ()))

        cost, audit, kept = rest(0, "")
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        out.add((conv, gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, sha))
    return out


def test_query_equals_the_contract(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = [tuple(r) for r in Q.op13_conversation_repair(spark, SMALL).collect()]
    assert len(got) == len(set(got)) and set(got) == simple(rows)


def test_odd_conversations(spark, tmp_path):
    import random

    random.seed(3)
    rows = [(None, None, None, None), (None, 3, "user", "Hi."), (1, None, "system", "Be good."), (1, 0, "user", "x"), (1, 0, "user", "x"), (1, 9, "", "y."), (2, 1, "usher", "Long " * 50_000 + "."), (2, 2, "assistant", " \n"), (3, -4, "tool", "é.\n "), (3, 2, "user", None)]
    rows += [(7, i // 3, random.choice(["user", "assistant", "system", "tool"]), random.choice(["Yes.", "no", "", "Why?", f"t{i}."])) for i in range(300)]
    rows += [(10 + i, t, random.choice(["user", "assistant", "system"]), f"{i} {t}.") for i in range(100) for t in range(6)]
    spark.createDataFrame([(*r, 1, "z", True) for r in rows], "conv_id long, turn long, role string, text string, conv int, digest string, live boolean").repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    got = [tuple(r) for r in Q.op13_conversation_repair(spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got)) and set(got) == simple(rows)
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "none" / "conversations.parquet"))
    assert Q.op13_conversation_repair(spark, str(tmp_path / "none")).count() == 0
