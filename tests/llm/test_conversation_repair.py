"""Repair of conversations against a search through all edits."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from allelemill.llm import conversation_repair as repair


def legal(initials: str) -> bool:
    return re.fullmatch("(s?(ua)+)?", initials) is not None


def brute(rows):
    """(cost, audit, repaired rows) of the cheapest edits of (role, text, fault), by trying everything up to two insertions at a place."""
    best = None
    inserts = ["", "u", "a", "ua", "au"]
    for puts in itertools.product(inserts, repeat=len(rows) + 1):
        for edits in itertools.product("DKR", repeat=len(rows)):
            cost, audit, turns = 0, "", []
            free = [["user", "assistant"] if e == "R" else [None] for e in edits]
            for roles in itertools.product(*free):
                cost, audit, turns, fine = 0, "", [], True
                for put, (role, text, fault), e, new in zip(puts, rows, edits, roles, strict=False):
                    for x in put:
                        audit, cost = audit + "I", cost + 2
                        turns.append(({"u": "user", "a": "assistant"}[x], ""))
                    audit += e
                    cost += {"D": 3, "K": 0, "R": 2}[e]
                    if e == "D":
                        continue
                    fine &= fault not in (repair.BLANK, repair.AGAIN)
                    cost += fault == repair.CUT
                    turns.append((new or role, text))
                for x in puts[-1]:
                    audit, cost = audit + "I", cost + 2
                    turns.append(({"u": "user", "a": "assistant"}[x], ""))
                if fine and legal("".join(r[:1] or "-" for r, _ in turns)) and (best is None or (cost, audit) < best[:2]):
                    best = cost, audit, turns
    return best


def test_solved_is_the_cheapest_and_least():
    draw = random.Random(5)
    cases = []
    for _ in range(60):
        cases.append([(draw.choice(["system", "user", "assistant", "tool"]), f"t{k}", draw.choice([0, 0, 0, 1, 2, 3])) for k in range(draw.randint(1, 3))])
    codes = [np.array([{"s": 0, "u": 1, "a": 2}.get(r[0], 3) + 4 * f for r, _, f in case]) for case in cases]
    for case, (edits, cost) in zip(cases, repair.solved(codes), strict=True):
        want = brute(case)
        assert (cost, edits.decode()) == want[:2], case


FAULTS = ["gaps", "blank", "duplicate", "truncated", "illegal"]


def plain(rows):
    """What the operator tells of one conversation's rows, in order, told row by row; costs by a programme over single rows."""
    seen, faults = set(), []
    for _, role, text in rows:
        fault = repair.BLANK if not re.search("[^\x20\x09-\x0d]", text) else repair.AGAIN if (role, text) in seen else repair.CUT if re.sub("[\x20\x09-\x0d]+$", "", text)[-1] not in ".!?" else 0
        seen.add((role, text))
        faults.append(fault)
    go = {0: [("s", 1), ("u", 2)], 1: [("u", 2)], 2: [("a", 3)], 3: [("u", 2)]}
    names = {2: "user", 3: "assistant"}
    after = [(0, "", ()), (4, "II", (("user", ""), ("assistant", ""))), (2, "I", (("assistant", ""),)), (0, "", ())]
    for (_, role, text), fault in list(zip(rows, faults, strict=True))[::-1]:
        own = []
        for q in range(4):
            ways = [(after[q][0] + 3, "D" + after[q][1], after[q][2])]
            if fault < repair.BLANK:
                new = go[q][-1][1]
                ways += [(after[to][0] + fault, "K" + after[to][1], ((role, text), *after[to][2])) for c, to in go[q] if role[:1] == c]
                ways.append((after[new][0] + 2 + fault, "R" + after[new][1], ((names[new], text), *after[new][2])))
            own.append(min(ways))
        for _ in range(3):
            own = [min(own[q], (own[go[q][-1][1]][0] + 2, "I" + own[go[q][-1][1]][1], ((names[go[q][-1][1]], ""), *own[go[q][-1][1]][2]))) for q in range(4)]
        after = own
    turns = [t for t, _, _ in rows if t is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:], strict=False)]
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, "blank": faults.count(2), "duplicate": faults.count(3), "truncated": faults.count(1),
        "illegal": sum(p not in ("su", "ua", "au") for p in pairs), "cost": after[0][0], "audit": after[0][1],
        "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in after[0][2]).encode()).hexdigest(),
    }


def told(found):
    return {r["conv_id"]: {k: r[k] for k in (*FAULTS, "cost", "audit", "repaired_sha256")} for r in found.collect()}


@pytest.mark.parametrize("bits", [1, 12])
def test_repaired(spark, bits):
    draw = random.Random(bits)
    rows = []
    for conv in [*range(12), None]:
        for turn in range(draw.choice([1, 2, 5, 9, 30])):
            if draw.random() < 0.8:
                role = draw.choice(["system", "user", "assistant", "user", "assistant", "x", ""])
                rows.append((conv, turn * draw.choice([1, 1, 2]) * 1000 + turn, role, draw.choice(["", " \n", "Ja.", "Ja. ", "No", f"Text {turn}!", f"Text {turn}"])))
    draw.shuffle(rows)
    whole = spark.createDataFrame(rows + [(99, 1, "user", "All gone.")], "conv_id long, turn long, role string, text string")
    found = told(repair.repaired(whole, spark.createDataFrame(rows, whole.schema), bits))
    empty = hashlib.sha256(b"").hexdigest()
    assert found.pop(99) == {**dict.fromkeys(FAULTS, 0), "cost": 0, "audit": "", "repaired_sha256": empty}
    by = {}
    for r in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        by.setdefault(r[0], []).append(r[1:])
    assert found == {k: plain(v) for k, v in by.items()}


def test_many_repeats_are_cut_into_pieces(spark):
    rows = spark.createDataFrame([(1, 5, "user", "Same."), (1, 6, "assistant", "Yes")], "conv_id long, turn long, role string, text string")
    many = rows.where("turn = 5").crossJoin(spark.range(40)).drop("id").unionByName(rows.where("turn = 6"))
    found = told(repair.repaired(many, many, 2))[1]
    assert found["audit"] == "K" + "D" * 39 + "K" and found["duplicate"] == 39 and found["cost"] == 39 * 3 + 1


def test_damage_and_odd_rows(spark):
    import zlib

    rows = [(c, t, "assistant", "A. b! c?") for c in range(3) for t in range(60)] + [(None, None, None, None)]
    got = {}
    for r in repair.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect():
        got.setdefault((r["conv_id"], r["turn"]), []).append((r["role"], r["text"]))
    for c, t, role, text in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        want = [] if k == 0 else [("user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text)] * (2 if k == 3 else 1)
        assert got.get((c, t), []) == want


def test_null_turns_empty_tables_and_other_columns(spark):
    rows = spark.createDataFrame([(7, None, "user", "A."), (7, None, "user", "A."), (7, 3, "assistant", "B."), (8, None, "tool", "C.")], "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS digest", "2 AS copy", "3 AS kind", "4 AS piece", "5 AS edits")
    found = told(repair.repaired(rows, rows))
    assert found[7]["audit"] == "KDK" and found[7]["gaps"] == 0 and found[7]["duplicate"] == 1
    assert found[8]["audit"] == "D" and found[8]["gaps"] == 0
    assert repair.repaired(rows.limit(0), rows.limit(0)).count() == 0


def test_a_long_text_is_hashed_whole(spark):
    text = "x" * 300_000 + "."
    rows = spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", "B.")], "conv_id long, turn long, role string, text string")
    assert told(repair.repaired(rows, rows))[1]["repaired_sha256"] == hashlib.sha256(f"user:{text}\nassistant:B.".encode()).hexdigest()
