"""Conversation repair against an exhaustive search and a plain reading of the rules."""

import hashlib
import random
import zlib

from ledgerloom.llm import conversations as C
from ledgerloom.llm.queries import damaged_conversations

WHITE = " \t\n\x0b\x0c\r"
STEP = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def brute(rows):
    """(cost, edits) from the end, over all edits: rows are (initial, fault)."""
    best = {"": (0, ""), "s": (6, "II"), "u": (3, "I"), "a": (0, "")}
    for initial, fault in reversed(rows):
        now = {}
        for at in ("", "s", "u", "a"):
            ways = []
            for inserted in range(3):
                place, cost, text = at, 3 * inserted, "I" * inserted
                for _ in range(inserted):
                    place = "a" if place == "u" else "u"
                due = "a" if place == "u" else "u"
                ways.append((cost + 4 + best[place][0], text + "D" + best[place][1]))
                if fault in (0, 3):
                    extra = 3 if fault == 3 else 0
                    kept = STEP.get((place, initial))
                    if kept:
                        ways.append((cost + extra + best[kept][0], text + "K" + best[kept][1]))
                    ways.append((cost + extra + 3 + best[due][0], text + "R" + best[due][1]))
            now[at] = min(ways)
        best = now
    return best[""]


def classes(rows):
    return bytes(("sua" + "x").index(i) | f << 2 for i, f in rows)


def test_search_finds_cheapest_and_least():
    rng = random.Random(11)
    for k in range(1200):
        n = rng.randrange(0, 9) if k % 3 else rng.randrange(0, 200)
        rows = [(rng.choice("suauaxua"), rng.choice((0, 0, 0, 1, 2, 3))) for _ in range(n)]
        assert C.cheapest_edits(classes(rows)) == brute(rows)


def test_search_of_long_conversations():
    rng = random.Random(12)
    rows = [("ua"[i % 2] if rng.random() < 0.9 else rng.choice("suax"), rng.choice((0,) * 9 + (1, 2, 3))) for i in range(20_000)]
    cost, edits = C.cheapest_edits(classes(rows))
    place, spent, left = "", 0, iter(rows)
    for e in edits:
        initial, fault = (None, 0) if e == "I" else next(left)
        spent += {"D": 4, "I": 3, "K": 0, "R": 3}[e] + (3 if fault == 3 and e != "D" else 0)
        assert e == "D" or fault in (0, 3)
        if e != "D":
            place = STEP[place, initial] if e == "K" else ("a" if place == "u" else "u")
    assert spent == cost and place in ("", "a") and next(left, None) is None


def expected(table):
    """The contract over plain rows (conv, turn, role, text)."""
    out = {}
    for conv in {r[0] for r in table}:
        rows = []
        for c, turn, role, text in (r for r in table if r[0] == conv):
            role, text = (" " if x is None else x for x in (role, text))
            kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if kind == 1 else text.translate({ord(x): None for x in ".!?"}) if kind == 2 else text
            rows += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        faults, seen = [], set()
        for _, role, text in rows:
            bare = text.strip(WHITE)
            faults.append(1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0)
            seen.add((role, text))
        turns = [t for t, _, _ in rows if t is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        cost, audit = brute([(r[1][:1], f) for r, f in zip(rows, faults)])
        place, left, kept = "", iter(rows), []
        for e in audit:
            due = "assistant" if place == "u" else "user"
            _, role, text = (None, due, "") if e == "I" else next(left)
            if e != "D":
                role = due if e == "R" else role
                place = role[0]
                kept.append(f"{role}:{text}")
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in (1, 2, 3)), illegal, cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def test_report_and_rows(spark, monkeypatch):
    rng = random.Random(13)
    table = []
    for conv in [*range(150), None]:
        for turn in range(rng.randrange(1, 12)):
            role = rng.choice(["user", "assistant", "system", "", "tool", None, "User"]) if rng.random() < 0.3 else ("user", "assistant")[turn % 2]
            text = rng.choice(["Yes.", "No!", "  ", "", None, "half a", "Why? \n", "é. ", "same.", "Well\x0b"])
            table.append((conv, rng.choice([turn, turn, turn, None, turn * 3]), role, text))
    table += table[:20]
    table += [(1000, t, "user" if t % 2 == 0 else "assistant", f"row {t}.") for t in range(3000)]  # one hot conversation
    table += [(1001, 0, "user", "long " * 4_000_000), (1001, 1, "assistant", "x" * 20_000_000 + ".")]
    df = spark.createDataFrame([(*r, 1, "x") for r in table], "conv_id long, turn long, role string, text string, fault int, key string")
    damaged = damaged_conversations(df)
    assert set(damaged.columns) == {"conv_id", "turn", "role", "text", "gone"}
    got = {r[0]: tuple(r[1:]) for r in C.repair_report(damaged, gone="gone").collect()}
    want = expected(table)
    assert got == want
    rows = {}
    for r in C.repair_conversations(damaged, gone="gone").where("conv_id is null or conv_id < 1001").orderBy("conv_id", "place").collect():
        rows.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    for conv, x in want.items():
        if conv != 1001:
            assert hashlib.sha256("\n".join(rows.get(conv, [])).encode()).hexdigest() == x[-1]
    none = df.where("false")
    assert C.repair_report(none).count() == 0 and C.repair_conversations(none).count() == 0
    assert C.repair_report(spark.createDataFrame([("a", 1, "user", "Hi.")], "place string, turn int, role string, text string"), conv="place").columns[0] == "place"


def test_spool_keeps_order(monkeypatch):
    monkeypatch.setattr(C, "SPOOL", 500)
    spool = C.Spool()
    rows = [(i, "user", "x" * (i % 90)) for i in range(300)]
    for r in rows:
        spool.add(r)
    assert spool.file is not None and list(spool) == rows == list(spool)
    spool.close()
