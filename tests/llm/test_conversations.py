"""Conversation repair: least paths against enumeration, the operator against brute force and SQL."""

import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest

from deliveryrisk.llm import conversations
from deliveryrisk.llm.queries import oracle_sql, queries
from tests.llm.sql import same_rows

PATH = "/root/testdata/sf0.001"
SPACES = " \t\n\v\f\r"
WANTED = re.compile("(s?(ua)+)?")


def cheapest(rows):
    """Least (cost, audit) and the repaired lines of rows (role, text, fault), by plain recursion over states."""
    from functools import cache

    follows = {"": "u", "s": "u", "u": "a", "a": "u"}
    names = {"u": "user", "a": "assistant"}

    @cache
    def best(i, state, inserts):
        out = []
        if i == len(rows) and state in ("", "a"):
            out.append((0, "", ()))
        if inserts < 3:
            c, a, t = best(i, follows[state], inserts + 1)
            out.append((c + 3, "I" + a, (names[follows[state]] + ":", *t)))
        if i < len(rows):
            role, text, fault = rows[i]
            c, a, t = best(i + 1, state, 0)
            out.append((c + 4, "D" + a, t))
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                if role[:1] == follows[state] or (state == "" and role[:1] == "s"):
                    c, a, t = best(i + 1, role[:1], 0)
                    out.append((c + more, "K" + a, (role + ":" + text, *t)))
                c, a, t = best(i + 1, follows[state], 0)
                out.append((c + more + 3, "R" + a, (names[follows[state]] + ":" + text, *t)))
        return min(out, default=(10**9, "", ()))

    return best(0, "", 0)


def marked(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.rstrip(SPACES)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated"
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def brute(table):
    """The whole contract for rows (conv_id, turn, role, text)."""
    convs = {}
    for conv, turn, role, text in table:
        rows = convs.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        rows += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        faults = marked([r[1:] for r in rows])
        turns = {t for t, _, _ in rows if t is not None}
        initials = [r[:1] for r, _, _ in faults]
        cost, audit, lines = cheapest(tuple(faults))
        count = [sum(f == k for _, _, f in faults) for k in ("blank", "duplicate", "truncated")]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, *count, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def codes(rows):
    faults = ["", "blank", "duplicate", "truncated"]
    return np.array([4 * (" sua".index(r[:1]) if r[:1] and r[:1] in "sua" else 0) + faults.index(f) for r, _, f in rows], dtype=np.int64)


@pytest.mark.parametrize("block", [1 << 15, 4])
def test_least_paths(monkeypatch, block):
    monkeypatch.setattr(conversations, "BLOCK", block)
    rng = np.random.default_rng(1)
    roles, faults = ["system", "user", "assistant", "tool", ""], ["", "", "", "blank", "duplicate", "truncated"]
    many = [
        tuple((roles[rng.integers(5)], str(i), faults[rng.integers(6)]) for i in range(n))
        for n in [0, 1, 1, 1, 2, 2, 2, 3, 3, 3, 5, 8, 13, 40] * 8
    ]
    for rows, found in zip(many, conversations.solve([codes(r) for r in many]), strict=True):
        cost, audit, lines = cheapest(rows)
        assert (found.cost, found.audit.tobytes().decode()) == (cost, audit)
        tokens = conversations.row_tokens(found, len(rows))
        named = {"u": "user:", "a": "assistant:"}
        mine = [named.get(t) or {"K": r, "U": "user", "A": "assistant"}[t] + ":" + x for (r, x, _), ts in zip(rows, tokens, strict=True) for t in ts]
        assert mine == list(lines)
        assert WANTED.fullmatch("".join(x[0] for x in mine))


def test_least_of_all_edits():
    """The recursion of these tests against all edit sequences of short conversations."""
    for rows in itertools.product([("s", "1", ""), ("u", "2", "truncated"), ("a", "3", ""), ("u", "4", "blank")], repeat=2):
        found = []
        for parts in itertools.product(*[[p + e for p in ("", "I", "II") for e in "KRD"] for _ in rows], ["", "I", "II"]):
            audit, i, out, cost = "".join(parts), 0, "", 0
            for e in audit:
                if e == "I" or e == "R":
                    out += "a" if out[-1:] == "u" else "u"
                if e == "K":
                    out += rows[i][0]
                if e != "I":
                    cost += {"K": 0, "R": 3, "D": 4}[e] + (3 if e != "D" and rows[i][2] == "truncated" else 0)
                    cost += 99 if e != "D" and rows[i][2] == "blank" else 0
                    i += 1
                else:
                    cost += 3
            if WANTED.fullmatch(out):
                found.append((cost, audit))
        assert min(found) == cheapest(rows)[:2]


TABLE = (
    [(1, t, r, x) for t, (r, x) in enumerate([("user", "Hi."), ("assistant", "No"), ("tool", "T."), ("user", ""), (None, None), ("user", "Hi.")])]
    + [(None, None, "user", "A."), (None, None, "assistant", "B!"), (None, 3, "", "C?"), (2, None, None, None)]
    + [(3, 1, "user", "same."), (3, 1, "user", "same."), (3, 1, "assistant", "x" * 100_000 + " \n"), (3, 9, "System", "é.")]
    + [(c, t, ["system", "user", "assistant"][(c + t) % 3], f"text {t % 4}" + ".!?,"[t % 4]) for c in range(10, 60) for t in range(c % 9)]
    + [(99, t, ["user", "assistant"][t % 2], "again." if t % 3 else f"{t}!") for t in range(150)]
)


@pytest.mark.parametrize("segment", [1 << 12, 8])
def test_repair_equals_brute_force(spark, monkeypatch, segment):
    monkeypatch.setattr(conversations, "SEGMENT", segment)
    frame = spark.createDataFrame([(*r, "x", 5) for r in TABLE], "conv_id long, turn long, role string, text string, audit string, at int")
    found, turns = conversations.repair(frame.repartition(4))
    got = {r.conv_id: tuple(r)[1:] for r in found.collect()}
    want = brute(TABLE)
    assert got == want
    lines = [x for r in turns.where("conv = 99").orderBy("at").collect() for x in r.lines]
    assert hashlib.sha256("\n".join(lines).encode()).hexdigest() == got[99][-1]


def test_empty_table(spark):
    frame = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversations.repair(frame)[0].count() == 0
    # the key 1:1 of this row drops it
    key = next(i for i in range(99) if zlib.crc32(f"1:{i}".encode()) % 20 == 0)
    frame = spark.createDataFrame([(1, key, "user", "Hi.")], "conv_id long, turn long, role string, text string")
    none = hashlib.sha256(b"").hexdigest()
    assert [tuple(r) for r in conversations.repair(frame)[0].collect()] == [(1, 0, 0, 0, 0, 0, 0, "", none)]


def test_query(spark):
    rows = queries()["op12_conversation_repair"](spark, PATH)
    same_rows(rows, oracle_sql()["op12_conversation_repair"], PATH, ["conversations"])
