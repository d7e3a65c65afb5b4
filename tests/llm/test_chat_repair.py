import hashlib
import heapq
import random
import zlib

import pytest
from pyspark.sql import functions as F
from test_scans import save

import crossfade.llm.chat_repair as R
from crossfade.llm.chat_repair import cheapest_edits, find_repairs, repair_conversations
from crossfade.llm.queries import op13_chat_repair

BLANK = " \t\n\x0b\x0c\r"


def accepts(roles):
    body = roles[1:] if roles[:1] == "s" else roles
    return body == "ua" * (len(body) // 2) and roles != "s"


def slow_edits(rows):
    """Best-first over whole edit scripts: rows are (initial, must go, cut)."""
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, roles = heapq.heappop(heap)
        if (i, roles, audit) in done:
            continue
        done.add((i, roles, audit))
        if i == len(rows) and accepts(roles):
            return cost, audit
        said = [r for r in "ua" if prefix(roles + r)]
        for r in said:
            heapq.heappush(heap, (cost + 2, audit + "I", i, roles + r))
        if i < len(rows):
            role, gone, cut = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, roles))
            if not gone:
                if role and role in "sua" and prefix(roles + role):
                    heapq.heappush(heap, (cost + cut, audit + "K", i + 1, roles + role))
                for r in said:
                    heapq.heappush(heap, (cost + 2 + cut, audit + "R", i + 1, roles + r))


def prefix(roles):
    body = roles[1:] if roles[:1] == "s" else roles
    return all(r == "ua"[i % 2] for i, r in enumerate(body))


def code(role, gone, cut):
    return ("sua".index(role) if role and role in "sua" else 3) | (R._MUST_GO if gone else 0) | (R._CUT if cut else 0)


def test_cheapest_edits_are_those_of_an_exhaustive_search():
    rng = random.Random(13)
    for _ in range(1500):
        rows = [(rng.choice(["s", "u", "a", "u", "a", "t", ""]), rng.random() < 0.15, 0) for _ in range(rng.randrange(0, 7))]
        rows = [(r, g, int(not g and rng.random() < 0.3)) for r, g, _ in rows]
        assert cheapest_edits(bytes(code(*r) for r in rows)) == slow_edits(rows), rows


def slow_long(rows):
    """The least (cost, letters) of each state, row by row."""

    def insert(best):
        for _ in range(4):
            for q, v in list(best.items()):
                for _, c, to in R._moves(q, None):
                    w = (v[0] + c, v[1] + "I")
                    best[to] = min(best.get(to, w), w)
        return best

    best = insert({0: (0, "")})
    for row in rows:
        after = {}
        for q, v in best.items():
            for letter, c, to in R._moves(q, code(*row)):
                if letter != "I":
                    w = (v[0] + c, v[1] + letter)
                    after[to] = min(after.get(to, w), w)
        best = insert(after)
    return min(best[q] for q in (0, 3) if q in best)


@pytest.mark.parametrize("block", [1, 7, 4096])
def test_blocks_make_no_difference(monkeypatch, block):
    monkeypatch.setattr(R, "_BLOCK", block)
    rng = random.Random(block)
    for n in (0, 1, 6, 7, 8, 14, 500, 700):
        rows = [(rng.choice("suaat"), rng.random() < 0.1, 0) for _ in range(n)]
        rows = [(r, g, int(not g and rng.random() < 0.3)) for r, g, _ in rows]
        assert cheapest_edits(bytes(code(*r) for r in rows)) == slow_long(rows)


def test_a_long_conversation_takes_time_near_its_length():
    rng = random.Random(1)
    codes = bytes(rng.choice([0, 1, 2, 3, 5, 9, 10, 2, 1]) for _ in range(300_000))
    cost, audit = cheapest_edits(codes)
    assert sum(x != "I" for x in audit) == len(codes) and cost > 0


def faults(rows):
    out, seen = [], set()
    for _, role, text in rows:
        fault = "blank" if not text.strip(BLANK) else "duplicate" if (role, text) in seen else "truncated" if text.rstrip(BLANK)[-1] not in ".!?" else None
        seen.add((role, text))
        out.append(fault)
    return out


def apply(rows, audit):
    out, roles, rows = [], "", iter(rows)
    for letter in audit:
        role, text = ("user" if not roles or roles[-1] in "sa" else "assistant"), ""
        if letter != "I":
            _, own, text = next(rows)
            role = own if letter in "KD" else role
        if letter != "D":
            out.append((letter, role, text))
            roles += role[0]
    assert accepts(roles) and next(rows, None) is None
    return out


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))


def brute(rows):
    rows = order(rows)
    found, turns = faults(rows), [t for t, _, _ in rows if t is not None]
    count = [sum(f == x for f in found) for x in ("blank", "duplicate", "truncated")]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    cost, audit = slow_long([(r[:1], f in ("blank", "duplicate"), int(f == "truncated")) for (_, r, _), f in zip(rows, found)])
    said = "\n".join(f"{role}:{text}" for _, role, text in apply(rows, audit))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, *count, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(said.encode()).hexdigest()


def damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if hit == 1 else "".join(c for c in text if c not in ".!?") if hit == 2 else text
        out.setdefault(conv, []).extend([(turn, "user" if hit == 4 else role, text)] * (0 if hit == 0 else 2 if hit == 3 else 1))
    return out


TEXTS = ["Well said.", "Open ended", "Yes!", "No?", "", " \t\r", "Same.", "Same.", None, "é.\x0b", "end.\x85", "x" * 300_000 + ".", " " * 300_000 + "x", "a\nuser:b."]
ROLES = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "User", "a", "unit"]


def conversations():
    rng = random.Random(8)
    rows = [(c, rng.choice([t, t, t, t + 3, None]), rng.choice(ROLES[: rng.choice([3, 5, 11])]), rng.choice(TEXTS[: rng.choice([8, 14])] if c % 40 == 0 else TEXTS[:8])) for c in range(300) for t in range(rng.randrange(1, 9))]
    rows += [(1000, t, "user" if t % 2 == 0 else "assistant", f"{t}.") for t in range(2, 900)] + [(None, t, ROLES[t], "n.") for t in range(4)] + [(1001, None, "user", None)] * 3
    rows += [(2000 + c, 0, "user", "alone.") for c in range(60)]  # some of them lose their only row
    return rows


def test_query_is_brute_force(spark, tmp_path):
    rows = conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("cost", F.lit("clash")).withColumn("a.b", F.lit(1))
    got = {r.conv_id: tuple(r)[1:] for r in op13_chat_repair(spark, save(spark, tmp_path, conversations=df.repartition(3))).collect()}
    own = damage(rows)
    assert set(got) == {r[0] for r in rows} and any(not v for v in own.values())
    for c, after in own.items():
        assert got[c] == (brute(after) if after else (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())), c


def test_repaired_rows(spark):
    rows = [(str(c), t, r or "", x or "") for c, t, r, x in conversations()]
    df = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string").withColumn("digest", F.lit("clash"))
    audits = {r.conv_id: r.audit for r in find_repairs(df).collect()}
    got = {}
    for r in repair_conversations(df).collect():
        got.setdefault(r.conv_id, []).append(r)
    for c in {r[0] for r in rows}:
        own = sorted(got[c], key=lambda r: r.place)
        assert [r.place for r in own] == list(range(len(own))) and "".join(r.edit for r in own) == audits[c]
        assert [(r.edit, r.role, r.text) for r in own if r.edit != "D"] == apply(order([r[1:] for r in rows if r[0] == c]), audits[c])
    assert repair_conversations(df.limit(0)).count() == 0 and find_repairs(df.limit(0)).count() == 0


def test_two_shuffles(spark, sf):
    plan = op13_chat_repair(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_COL") == 2 and "Cartesian" not in plan
