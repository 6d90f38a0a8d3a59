"""Conversation repair against brute force over all edits."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest

from barriometrics.llm import conversation_repair

SCHEMA = "conv_id long, turn long, role string, text string, dropped_by string, audit int"


def damaged(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        out[conv]
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        row = (turn, "user" if kind == 4 else role, text)
        out[conv] += [row, row] if kind == 3 else [row]
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])) for c, r in out.items()}


def cheapest(rows, faults):
    """Cheapest-first search over (cost, audit): the first finished one is the answer."""
    queue, done = [(0, "", 0, "", ())], set()
    while queue:
        cost, audit, i, roles, lines = heapq.heappop(queue)
        if (i, roles[-1:]) in done:
            continue
        done.add((i, roles[-1:]))
        legal = lambda r: re.fullmatch("s?(ua)*u?", r)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit, "\n".join(lines)
        for name in ("user", "assistant"):
            if legal(roles + name[0]) and len(audit) < 4 * len(rows) + 4:
                heapq.heappush(queue, (cost + 3, audit + "I", i, roles + name[0], (*lines, name + ":")))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(queue, (cost + 4, audit + "D", i + 1, roles, lines))
            if faults[i] not in ("blank", "duplicate"):
                extra = 3 if faults[i] == "truncated" else 0
                if role and role[0] in "sua" and legal(roles + role[0]):
                    heapq.heappush(queue, (cost + extra, audit + "K", i + 1, roles + role[0], (*lines, f"{role}:{text}")))
                for name in ("user", "assistant"):
                    if legal(roles + name[0]):
                        heapq.heappush(queue, (cost + 3 + extra, audit + "R", i + 1, roles + name[0], (*lines, f"{name}:{text}")))


def brute(rows):
    out = {}
    for conv, mine in damaged(rows).items():
        faults, seen = [], set()
        for _, role, text in mine:
            bare = re.sub(r"[\x20\x09-\x0D]", "", text)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, _, _ in mine if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        cost, audit, body = cheapest(mine, faults)
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(body.encode()).hexdigest())
    return out


def conversations(seed, count):
    rng = random.Random(seed)
    rows = []
    for conv in range(count):
        for turn in range(rng.randint(0, 9)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "sys"])
            text = rng.choice(["Hello.", "no end", "What?", "Hello.", "", " \t", None, "été!", f"row {turn}.", "a:b\nuser: c. \x0b"])
            rows.append((rng.choice([conv, conv, conv, None]) if conv % 17 == 0 else conv, rng.choice([turn, turn, turn, None, turn * 3]), role, text))
    return rows


def as_frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(5)


@pytest.mark.parametrize("seed", [1, 2])
def test_repair_matches_brute_force(spark, seed):
    rows = conversations(seed, 250)
    got = conversation_repair.report(as_frame(spark, rows)).collect()
    expected = brute(rows)
    assert len(got) == len(expected)
    for r in got:
        assert tuple(r)[1:] == expected[r["conv_id"]], r["conv_id"]


def test_giant_conversation_spills_and_comes_back(spark, tmp_path):
    rng = random.Random(3)
    rows = [(5, t, rng.choice(["user", "assistant"]), f"text {t}" + rng.choice(["", ".", "!"])) for t in range(3_000)]
    rows += [(6, 0, "user", "x" * 300_000 + "."), (6, 1, "assistant", "Long." * 50_000)]
    frame = as_frame(spark, rows)
    whole = {r["conv_id"]: tuple(r) for r in conversation_repair.report(frame).collect()}
    spilt = {r["conv_id"]: tuple(r) for r in conversation_repair.repair(conversation_repair.damage(frame), chunk_rows=7).collect()}
    assert whole == spilt and len(whole[5][7]) > 2_500
    assert {c: r[1:] for c, r in whole.items()} == brute(rows)


def test_repaired_rows_are_those_of_the_audit(spark):
    rows = conversations(9, 120)
    spoilt = conversation_repair.damage(as_frame(spark, rows))
    found = conversation_repair.repair(spoilt)
    lines = defaultdict(list)
    for r in sorted(conversation_repair.repaired_rows(spoilt, found).collect(), key=lambda r: r["place"]):
        assert (r["turn"] is None) or r["edit"] != "I"
        lines[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    for r in found.collect():
        assert hashlib.sha256("\n".join(lines[r["conv_id"]]).encode()).hexdigest() == r["repaired_sha256"]


def test_all_rows_dropped_and_empty_table(spark):
    gone = next(c for c in range(1_000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    (row,) = conversation_repair.report(as_frame(spark, [(gone, 1, "user", "Text.")])).collect()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert conversation_repair.report(as_frame(spark, [(1, 1, "user", "x")]).limit(0)).count() == 0
