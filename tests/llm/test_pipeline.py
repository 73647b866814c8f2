"""The corpus pipeline, stage by stage, against brute force on small tables."""

import base64
import hashlib
import random
import re

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken

import corpus_pipeline
from ledgerloom.llm import quality
from ledgerloom.llm.common import text_bytes

from .test_operators import brute_components, edited, words

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, home = random.Random(31), tmp_path_factory.mktemp("tables")
    base, passage, item = words(150, 1), words(40, 2), words(30, 3)
    docs, labels = [], []
    for i in range(160):
        text = " ".join(f"u{i}x{rng.randrange(50)}" for _ in range(rng.randrange(20, 60)))
        if i % 8 == 1:
            text = edited(base, 0.01 * (i % 3), i)
        elif i % 8 == 2:
            text = f"{text} {passage} {text[::-1]}"
        elif i % 8 == 3:
            text = f"{text}, {item.upper()} end {text[:20]}"
        elif i % 8 == 4:
            text = item if i % 16 == 4 else f"x {item} y"
        good = i % 5 > 0
        docs.append((i, text if good else " ".join(w + "%%!!" for w in text.split())))
        labels.append((i, int(good), 0))
    docs += [(200, None), (201, ""), (202, docs[1][1]), (202, docs[1][1]), (None, docs[9][1]), (None, None), (203, "é" * 150 + " " + "é" * 150)]
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in docs]
    spark.createDataFrame(rows, DOCUMENTS).repartition(3).write.parquet(f"{home}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{home}/labels.parquet")
    spark.createDataFrame([(1, item), (2, "short item here"), (3, None)], "item_id long, text string").write.parquet(f"{home}/benchmark.parquet")
    return str(home)


def rows_of(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))


def brute_quality(machine, text):
    """The factorisation machine by its definition: all pairs of inputs."""
    buf, offs = text_bytes(pa.array([text], pa.string()))
    _, col, x = machine.inputs(buf, offs)
    z = machine.bias + machine.linear[col] @ x
    inner = machine.factors[col] @ machine.factors[col].T * np.outer(x, x)
    return 1 / (1 + np.exp(-np.clip(z + np.triu(inner, 1).sum(), -30, 30)))


def brute_cut(rows, size=100):
    """Texts without characters all of whose bytes lie in strings that came before; empty ones go."""
    seen, out = set(), []
    for i, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - size + 1):
            if raw[p : p + size] in seen:
                gone[p : p + size] = b"\1" * size
            seen.add(raw[p : p + size])
        if not any(gone):
            out.append((i, t))
            continue
        left, at = "", 0
        for c in t:
            n = len(c.encode())
            left += "" if all(gone[at : at + n]) else c
            at += n
        if left.strip():
            out.append((i, left))
    return out


def brute_decontaminated(text, items, window=10):
    if text is None:
        return None
    spans = [m.span() for m in re.finditer(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.encode().lower())]
    raw = text.encode()
    w = [raw[a:b].lower() for a, b in spans]
    hit = set()
    for body in items:
        x = [m.group() for m in re.finditer(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (body or "").encode().lower())]
        n = min(window, len(x))
        grams = {tuple(x[k : k + n]) for k in range(len(x) - n + 1)} if n else set()
        for k in range(len(w) - n + 1):
            if n and tuple(w[k : k + n]) in grams:
                hit |= set(range(k, k + n))
    if len(hit) > 200 or len(hit) > 0.5 * len(w):
        return False
    if not hit:
        return text
    parts, last = [], 0
    for k in sorted(hit):
        if k - 1 not in hit:
            parts.append(raw[last : spans[k][0]])
        last = spans[k][1]
    return b" ".join(x.strip() for x in [*parts, raw[last:]] if x.strip()).decode()


def test_every_stage_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    machine = quality.fit_quality(docs, labels, "quality")
    kept = stages["quality"](spark, docs, folder)
    want = [r for r in rows_of(docs) if brute_quality(machine, r[1]) >= 0.5]
    assert rows_of(kept) == want and 90 < len(want) < len(rows_of(docs))

    kept = stages["near_duplicates"](spark, spark.createDataFrame(kept.collect(), DOCUMENTS), folder)
    components = {}
    for line in brute_components(want, 5, 4, 5):
        i, _, _, stays = eval(line)
        components[i] = components.get(i, False) or stays
    texts = {}
    for i, t in want:
        if components[i] and not (i is None and (t or "").strip()):
            texts.setdefault((i, t or ""), t)
    want = sorted(((i, t) for (i, _), t in texts.items()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    assert [(i, t or "") for i, t in rows_of(kept)] == [(i, t or "") for i, t in want] and 202 not in [i for i, _ in want]

    kept = stages["suffix_dedup"](spark, spark.createDataFrame(kept.collect(), DOCUMENTS), folder)
    cut = brute_cut(want)
    assert rows_of(kept) == cut and cut != want
    assert all(r["n_chars"] == len(r["text"] or "") or r["text"] is None for r in kept.collect())

    kept = stages["decontamination"](spark, spark.createDataFrame(kept.collect(), DOCUMENTS), folder)
    items = [r["text"] for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    clean = [(i, brute_decontaminated(t, items)) for i, t in cut]
    clean = [(i, t) for i, t in clean if t is not False]
    assert rows_of(kept) == clean and len(clean) < len(cut) and clean != [r for r in cut if r in clean]

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids = [lib.encode_ordinary(t or "") for _, t in clean]
    want = [(i, len(x), hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for (i, t), x in zip(clean, ids)]
    got = corpus_pipeline.run(spark, folder).collect()  # all stages in a row
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_stages_keep_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).schema.simpleString() == docs.schema.simpleString()
        assert stage(spark, docs.where("false"), folder).count() == 0
