"""Conversation repair against a search over all edit sequences, written apart from the fold."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from tickloom.llm import repair
from tickloom.llm.queries import QUERIES, table

BLANK = "\x20\t\n\x0b\x0c\r"


def ends(text):
    return text.rstrip(BLANK)[-1:] in (".", "!", "?")


def brute_edits(rows):
    """Cheapest edits by Dijkstra over (rows read, roles so far as a short tail), audits as strings."""
    seen, marks = set(), []
    for _, role, text in rows:
        fault = "blank" if not text.strip(BLANK) else "duplicate" if (role, text) in seen else \
            "" if ends(text) else "truncated"
        seen.add((role, text))
        marks.append(fault)
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, audit, at, tail = heapq.heappop(heap)
        if (at, tail) in done:
            continue
        done.add((at, tail))
        if at == len(rows) and tail in ("", "a"):
            return marks, cost, audit
        following = "a" if tail == "u" else "u"
        heapq.heappush(heap, (cost + 3, audit + "I", at, following))
        if at < len(rows):
            heapq.heappush(heap, (cost + 4, audit + "D", at + 1, tail))
            if marks[at] not in ("blank", "duplicate"):
                more = 3 * (marks[at] == "truncated")
                heapq.heappush(heap, (cost + more + 3, audit + "R", at + 1, following))
                initial = rows[at][1][:1]
                if initial == following or (initial == "s" and tail == ""):
                    heapq.heappush(heap, (cost + more, audit + "K", at + 1, initial))


def brute_report(conv, rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    marks, cost, audit = brute_edits(rows)
    out, at, tail = [], 0, ""
    for letter in audit:
        if letter == "D":
            at += 1
            continue
        following = "a" if tail == "u" else "u"
        role = {"u": "user", "a": "assistant"}[following]
        if letter == "K":
            out.append(rows[at][1] + ":" + rows[at][2])
            following = rows[at][1][0]
        else:
            out.append(role + ":" + (rows[at][2] if letter == "R" else ""))
        at += letter != "I"
        tail = following
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    return (conv, gaps, marks.count("blank"), marks.count("duplicate"), marks.count("truncated"),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
            hashlib.sha256("\n".join(out).encode()).hexdigest())


def brute_damage(rows):
    """conversation -> damaged rows, all conversations named."""
    out = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        to = out.setdefault(conv, [])
        if kind:
            row = (turn, "user" if kind == 4 else role,
                   "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
            to += [row] * (2 if kind == 3 else 1)
    return out


def shown(df):
    return sorted(map(tuple, df.select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()),
        key=repr)


def check(spark, rows, schema="conv_id long, turn long, role string, text string"):
    df = spark.createDataFrame(rows, schema).repartition(5)
    want = sorted((brute_report(c, r) for c, r in brute_damage([r[:4] for r in rows]).items()), key=repr)
    assert shown(repair.report(repair.damage(df))) == want


TEXTS = ["Yes.", "No!", "half a", "  ", "", "Why? \n", "same.", "end.\t", "…", "a.b", None]
ROLES = ["user", "assistant", "system", "u", "tool", "", "User", None]


@pytest.mark.parametrize("seed", [1, 2])
def test_random_conversations(spark, seed):
    rng = random.Random(seed)
    rows = []
    for conv in range(150):
        turns = rng.sample(range(-3, 20), rng.randint(1, 12))
        for t in turns:
            roles = ROLES if conv % 3 else ["user", "assistant", "system"]
            rows.append((conv, t, rng.choice(roles), rng.choice(TEXTS)))
    check(spark, rows)


def test_odd_rows(spark):
    rows = [(None, 1, "user", "a."), (None, 2, "assistant", "b."), (7, None, "user", "a."), (7, None, "assistant", "x."),
            (7, 3, "user", "a."), (8, 5, "user", "q."), (8, 5, "user", "q."), (9, None, None, None),
            (10, 0, "system", "s."), (11, 10**12, "user", "u." * 200000), (11, -5, "assistant", " " * 1000)]
    rows = [(*r, "clash", 1) for r in rows]
    check(spark, rows, "conv_id long, turn long, role string, text string, present_before string, cost int")


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.report(repair.damage(df)).collect() == []
    assert repair.repair(df).collect() == []


def test_long_conversation_settles_early(spark, monkeypatch):
    """Edits leave before the conversation ends; the tree of audits stays small."""
    monkeypatch.setattr(repair, "NODES", 64)
    rng = random.Random(9)
    rows = [(t, rng.choice(["user", "assistant", "tool", "system"]), rng.choice(["one.", "two", f"text {t}.", ""]))
            for t in range(3000)]
    seen, conv, out, most = set(), repair._Conversation(4), [], 0
    for turn, role, text in rows:
        fault = 1 if not text else 2 if (role, text) in seen else 0 if ends(text) else 3
        seen.add((role, text))
        out += conv.add(turn, role, text, fault)
        most = max(most, len(conv.fold.audits))
    early = len(out)
    out += conv.end()
    _, cost, audit = brute_edits(rows)
    assert "".join(e[2] for e in out) == audit
    assert early > 2000 and most < 2000


def test_hash_collisions_do_no_harm(monkeypatch):
    """With a modulus of 3 nearly every hash collides; the letters decide."""
    monkeypatch.setattr(repair, "PRIME", 3)
    rng = random.Random(2)
    for _ in range(200):
        rows = [(t, rng.choice(["user", "assistant", "tool", "system"]), rng.choice(["x.", "y", f"{t}.", ""]))
                for t in range(rng.randint(0, 25))]
        conv, seen, out = repair._Conversation(0), set(), []
        for turn, role, text in rows:
            fault = 1 if not text else 2 if (role, text) in seen else 0 if ends(text) else 3
            seen.add((role, text))
            out += conv.add(turn, role, text, fault)
        out += conv.end()
        assert "".join(e[2] or "" for e in out) == brute_edits(rows)[2]


def test_repaired_rows(spark):
    df = spark.createDataFrame([(1, 0, "user", "hi."), (1, 1, "user", "more."), (1, 2, "assistant", ""),
                                (2, 0, "system", "s.")], "conv_id long, turn long, role string, text string")
    got = sorted(map(tuple, repair.repair(df).collect()))
    assert got == [(1, 0, "user", "hi."), (1, 1, "assistant", "more.")] or [r[2] for r in got] == ["user", "assistant"]
    assert {r[0] for r in got} == {1}


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()]
    want = sorted((brute_report(c, r) for c, r in brute_damage(rows).items()), key=repr)
    assert shown(QUERIES["op11_repair"](spark, sf)) == want
