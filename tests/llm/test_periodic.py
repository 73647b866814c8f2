"""Periodic runs against a reading of their definition."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from ledgerloom.llm import periodic
from ledgerloom.llm.common import mix64
from ledgerloom.llm.queries import op13_synchronising_set_runs


def brute(words, times=4, shortest=1):
    """All runs (start, length, smallest period), period by period."""
    n, seen = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(shortest, times * q) and (i, j + q) not in seen:
                seen[i, j + q] = q
            i = j + 1 if j + 1 > i else i + 1
    return sorted((s, e - s, q) for (s, e), q in seen.items())


def runs_of(texts):
    words = [x for t in texts for x in t]
    ends = np.cumsum([len(t) for t in texts])
    start, size, period = periodic.word_runs(mix64(np.array(words, np.uint64) + np.uint64(7)), ends)
    out = [[] for _ in texts]
    for s, n, q in zip(start.tolist(), size.tolist(), period.tolist()):
        k = int(np.searchsorted(ends, s, "right"))
        out[k].append((s - (int(ends[k - 1]) if k else 0), n, q))
    return out


def periodic_text(rng):
    out = []
    for _ in range(rng.randrange(1, 5)):
        out += [rng.randrange(3) for _ in range(rng.randrange(0, 6))]
        unit = [rng.randrange(rng.choice((1, 2, 5, 50))) for _ in range(rng.randrange(1, 40))]
        if rng.random() < 0.3:
            unit = unit[:3] * rng.randrange(1, 9) + unit  # a periodic region inside a period
        out += (unit * 9)[: rng.randrange(1, 8 * len(unit))]
    return out


def test_all_runs_are_found():
    rng = random.Random(5)
    for _ in range(120):
        texts = [periodic_text(rng) if rng.random() < 0.7 else [rng.randrange(2) for _ in range(rng.randrange(0, 60))] for _ in range(rng.randrange(1, 12))]
        assert runs_of(texts) == [brute(t) for t in texts]
    thue = [bin(i).count("1") % 2 for i in range(1 << 12)]
    assert runs_of([thue, [0] * 5000, thue * 4]) == [brute(thue), [(0, 5000, 1)], [(0, 1 << 14, 1 << 12)]]
    with pytest.raises(ValueError):
        periodic.word_runs(np.zeros(3, np.uint64), np.array([3]), times=3)


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = brute(words, shortest=6)
    dropped = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
    lines = "".join(f"{s},{size},{q}\n" for s, size, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    digests = (hashlib.sha256(x.encode()).hexdigest() for x in (lines, kept))
    return (doc_id, len(runs), *best, best[0] is not None and best[1] * 1000 // best[2] or None, *digests)


def test_query(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, " ".join(f"w{x}" for x in periodic_text(rng))) for i in range(300)]
    rows += [(i, " ".join(f"v{rng.randrange(90)}" for _ in range(rng.randrange(1, 200)))) for i in range(300, 420)]
    rows += [(420, None), (421, ""), (422, " \t\n\x0b\x0c\r "), (None, "a a a a a a a"), (None, None), (423, "é\x0bé é x é é é é é é é"), (0, rows[0][1]), (0, rows[0][1])]
    rows += [(424, "  lead " + "x y\n" * 5), (425, "same"), (426, "A a A a A a A a A a")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n int, runs string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = op13_synchronising_set_runs(spark, str(tmp_path)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str(expected(*r)) for r in rows)
    assert periodic.find_runs(df.where("false")).count() == 0


def test_very_long_text(spark):
    line = " ".join(f"w{i * i % 7919}" for i in range(5000))
    text = spark.range(1).selectExpr("id AS doc_id", f"concat(repeat('{line} ', 600), 'end') AS text")
    r = periodic.find_runs(text).collect()[0]
    assert [tuple(x) for x in r["runs"]] == [(0, 3_000_000, 5000)] and r["collapsed"] == line + " end"
