"""Repaired conversations against trying all edits."""

import hashlib
import random
import re
import zlib
from functools import cache

import numpy as np
import pytest

from lodework.llm import turns

WS = "\x20\x09-\x0d"


def damage(rows):
    """Rows (conv, turn, role, text) to conv -> its rows after damage, in order."""
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        how = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if how == 0:
            continue
        text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
        out[conv] += [(turn, "user" if how == 4 else role, text)] * (2 if how == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2].encode())) for c, r in out.items()}


def faults_of(rows):
    out, seen = [], set()
    for _, role, text in rows:
        body = re.findall(f"[^{WS}]", text)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, faults):
    """(cost, audit) over all edits, by the shape of what they give and nothing else."""

    @cache
    def rest(i, shape, inserted):
        """Least (cost, audit) of edits from row i on, after rows of such roles."""
        best = (0, "") if i == len(rows) and re.fullmatch("(s?(ua)+)?", shape) else (10**9, "")

        def consider(cost, letter, i, shape, inserted):
            nonlocal best
            if re.fullmatch("s?(ua)*u?", shape):
                c, audit = rest(i, shrink(shape), inserted)
                best = min(best, (cost + c, letter + audit))

        if inserted < 3:
            for role in "ua":
                consider(2, "I", i, shape + role, inserted + 1)
        if i < len(rows):
            _, role, _ = rows[i]
            consider(3, "D", i + 1, shape, 0)
            if faults[i] not in ("blank", "duplicate"):
                cut = faults[i] == "truncated"
                if role:
                    consider(cut, "K", i + 1, shape + role[0], 0)
                for to in "ua":
                    consider(2 + cut, "R", i + 1, shape + to, 0)
        return best

    def shrink(shape):
        """Another shape that the same endings make legal."""
        return re.sub("(ua)+", "ua", shape)

    return rest(0, "", 0)


def expected(rows):
    out = {}
    for conv, some in damage(rows).items():
        faults = faults_of(some)
        cost, audit = cheapest(some, faults)
        lines, left, last = [], list(some), ""
        for letter in audit:
            role, text = ("", "") if letter == "I" else left.pop(0)[1:]
            if letter == "D":
                continue
            if letter != "K":
                role = "assistant" if last == "u" else "user"
            last = role[0]
            lines.append(f"{role}:{text}")
        numbers = [t for t, _, _ in some if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        pairs = [(a[1][:1] + b[1][:1]) for a, b in zip(some, some[1:])]
        out[conv] = (gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def made(seed, convs=120, longest=9):
    r = random.Random(seed)
    texts = ["Yes.", "Yes.", "no", "What?", "  ", "", None, "a. \n", "é!", "cut off", "x.y"]
    roles = ["user", "assistant"] * 4 + ["system", "system", "tool", None, "User", "ufo", ""]
    rows = []
    for conv in range(convs):
        regular = r.random() < 0.5
        for turn in range(r.randint(1, longest)):
            role = ("user", "assistant")[turn % 2] if regular and r.random() < 0.9 else r.choice(roles)
            rows.append((conv, None if r.random() < 0.05 else turn + r.randint(0, 1), role, f"{r.random()}." if r.random() < 0.6 else r.choice(texts)))
    rows += [(None, 1, "user", "hi."), (None, 2, "assistant", "yes."), (None, None, None, None)]
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


def run(spark, rows, parts=3):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS range", "'x' AS audit", "2 AS place", "'c' AS c").repartition(parts)
    return {r.conv_id: tuple(r)[1:] for r in turns.repaired(df).collect()}


@pytest.mark.parametrize("piece", [2, 4096])
def test_repairs_of_brute_force(spark, monkeypatch, piece):
    """Pieces of two rows send most conversations through the folds; with long pieces only those at borders of ranges."""
    monkeypatch.setattr(turns, "PIECE", piece)
    monkeypatch.setattr(turns, "TOGETHER", 7)
    rows = made(piece)
    want = expected(rows)
    assert run(spark, rows) == want
    assert any("I" in w[6] for w in want.values()) and any("R" in w[6] for w in want.values())


def test_one_conversation_of_many_rows(spark, monkeypatch):
    monkeypatch.setattr(turns, "PIECE", 64)
    rows = [(7, i, ("user", "assistant", "user")[i % 3], f"{i}" + "." * (i % 5 > 0)) for i in range(5000)] + [(8, 0, "user", "a.")]
    some = damage(rows)[7]
    faults = [{"": 0, "blank": 1, "duplicate": 2, "truncated": 3}[f] for f in faults_of(some)]
    whole = next(turns._whole([(7, some)]))[1]
    assert run(spark, rows)[7] == whole
    assert whole[5] == turns.costs_to_end([turns.initial_code(r[1]) for r in some], faults, turns.ACCEPTED, True)[0, 0]


def test_least_audits_look_as_far_as_needed():
    """Arcs of one letter to different nodes, as no edit gives them: only the letters that follow decide."""
    r = random.Random(4)
    for _ in range(200):
        n = r.randint(2, 9)
        arcs = sorted({(a, r.choice("DIKR"), b) for a in range(n) for b in range(a + 1, n + 1) if r.random() < 0.5} | {(a, "K", a + 1) for a in range(n)})
        best = {n: ""}
        for a in range(n - 1, -1, -1):
            best[a] = min(letter + best[b] for x, letter, b in arcs if x == a)
        a, letters, b = zip(*arcs)
        distinct = all(len({y for p, q, y in arcs if (p, q) == (x, z)}) == 1 for x, z, _ in arcs)
        got = turns.least_audits(np.array(a), np.array([ord(x) for x in letters]), np.array(b), n + 1, np.arange(n))
        if distinct:
            assert got == [best[i] for i in range(n)]


def test_empty_and_lost(spark):
    assert run(spark, []) == {}
    lost = next(c for c in range(1000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    assert run(spark, [(lost, 1, "user", "hello.")]) == {lost: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}
