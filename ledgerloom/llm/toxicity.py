"""Toxicity: a support vector machine over a gapped subsequence string kernel, with Nyström landmarks.

The kernel compares *windows* of sentences, one to ``MOST_WORDS`` words in a row, by their
subsequences of three characters; an occurrence that spans s characters weighs LAMBDA**s (Lodhi et
al., 2002, with spans bounded by ``SPAN``), so inserted and dropped characters cost little, and a
space is a character like others, so insults of several words have a shape too.  Values are divided
by the windows' norms, counting occurrences as distinct.  Texts are read through marks and single
spaced letters: "i d i o t", "id-i.ot" and "IDIOT!!" are all "idiot"; letters of other scripts stay apart as
far as ``SYMBOLS`` allows.

Training takes labelled documents, at most ``max_train`` of them, and the windows of all their
sentences; a label says that some window of a document is toxic, not which one, so the machine is a
multiple-instance SVM (Andrews et al., 2002).  The best windows of each toxic document and those of
the others are its instances.  Which ones are best is a likelihood ratio over documents in the first
round; in the next ones the machine of the round before ranks all windows.  A linear SVM is trained
on the instances' Nyström features, whose landmarks are windows of both kinds.  Since the kernel has
explicit features, a machine collapses into one weight for each subsequence, so scoring is linear in
the text.  A logistic step maps a document's largest, summed and frequent window scores to a
probability.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean_worker, materialize, row_blocks, text_bytes
from .quality import training_rows

LAMBDA, SPAN = 0.6, 7
MOST_WORDS = 2
#: Longer words count as several, without a space between them.
LONG_WORD = 32
#: Windows of fewer places are measured as if they had so many.
SHORTEST = 7
LANDMARKS = 256
ROUNDS = 2
#: Bounds of the training: labelled documents, and the windows that the driver sees of each in a round.
MAX_TRAIN = 6000
TOP = 3
#: In the first round a window counts as toxic from this log-likelihood ratio on.
SURE = 6.0

#: Symbols of characters: 0 none (between sentences), 1 a space, letters from 2, digits from 28, others from 38.
SYMBOLS, _BITS = 128, 7
_BREAK, _SPACE, _MARK, _GONE = 0, 1, 254, 255


def _symbol_of(point: int) -> int:
    """The symbol of a code point, case aside: its own for a-z and 0-9, else one of the last 90."""
    low = chr(point).lower()[0]
    if "a" <= low <= "z":
        return 2 + ord(low) - 97
    if "0" <= low <= "9":
        return 28 + ord(low) - 48
    return 38 + ord(low) % (SYMBOLS - 38)


_FOLDED = np.array([_symbol_of(p) for p in range(0x590)], np.uint8)  # Latin, Greek, Cyrillic
_ASCII = np.full(256, _GONE, np.uint8)
for _c in range(128):
    if chr(_c).isalnum():
        _ASCII[_c] = _FOLDED[_c]
_ASCII[[32, 9, 11, 12]] = _SPACE
_ASCII[[10, 13]] = _BREAK
_ASCII[[33, 46, 63]] = _MARK  # ends a sentence if white space follows


def characters(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of UTF-8 texts without marks, and the rows' offsets."""
    sym = _ASCII[buf]
    lead = np.flatnonzero(buf >= 0xC0)
    if len(lead):
        byte = lambda k: buf[np.minimum(lead + k, len(buf) - 1)].astype(np.int64)
        one, two, three, four = byte(0), byte(1) & 63, byte(2) & 63, byte(3) & 63
        point = np.where(one < 0xE0, (one & 31) << 6 | two, np.where(one < 0xF0, (one & 15) << 12 | two << 6 | three, (one & 7) << 18 | two << 12 | three << 6 | four))
        sym[lead] = np.where(point < len(_FOLDED), _FOLDED[np.minimum(point, len(_FOLDED) - 1)], 38 + point % (SYMBOLS - 38))
    ends = np.flatnonzero(sym == _MARK)
    if len(ends):
        follows = ends + 1 >= len(buf)
        follows |= sym[np.minimum(ends + 1, len(buf) - 1)] <= _SPACE
        sym[ends] = np.where(follows, _BREAK, _GONE)
    kept = sym != _GONE
    sums = np.concatenate([[0], np.cumsum(kept)])
    return sym[kept], sums[offs]


def _word_bounds(sym: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = sym >= 2
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = offs[(offs > 0) & (offs < len(sym))]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


class Sentences:
    """Texts as symbols, sentence by sentence, and their words.

    ``codes`` has each sentence's words with a space before and after each, and ``SPAN - 1`` zeros
    behind, so that no subsequence reaches into the next one.  ``start``, ``end``: where a word's
    leading space and its own end stand; ``row``, ``sentence`` of each word.
    """

    def __init__(self, buf: np.ndarray, offs: np.ndarray):
        sym, offs = characters(buf, offs)
        s, e = _word_bounds(sym, offs)
        single = e - s == 1
        row = np.searchsorted(offs, s, "right") - 1
        joined = np.flatnonzero(single[:-1] & single[1:] & (row[1:] == row[:-1]) & (s[1:] == e[:-1] + 1) & (sym[np.minimum(e[:-1], max(len(sym) - 1, 0))] == _SPACE)) if len(s) else np.zeros(0, int)
        if len(joined):  # letters with spaces between them are one word
            kept = np.ones(len(sym), bool)
            kept[e[joined]] = False
            sums = np.concatenate([[0], np.cumsum(kept)])
            sym, offs = sym[kept], sums[offs]
            s, e = _word_bounds(sym, offs)
        breaks = np.concatenate([[0], np.cumsum(sym == _BREAK)])
        number = np.searchsorted(offs, s, "right") - 1
        mark = breaks[s] if len(s) else np.zeros(0, np.int64)
        # Long words in pieces.
        n = np.maximum(1, -(-(e - s) // LONG_WORD))
        word = np.repeat(np.arange(len(s)), n)
        turn = np.arange(len(word)) - np.repeat(np.cumsum(n) - n, n)
        ps = s[word] + turn * LONG_WORD
        pe = np.minimum(ps + LONG_WORD, e[word])
        self.row, mark = number[word], mark[word]
        last_piece = np.append(word[1:] != word[:-1], True) if len(word) else np.zeros(0, bool)
        new = np.ones(len(word), bool)
        new[1:] = (self.row[1:] != self.row[:-1]) | (mark[1:] != mark[:-1])
        self.sentence = np.cumsum(new) - 1
        ends = np.append(new[1:], True) if len(new) else new
        # A space opens each sentence, and one follows each whole word; zeros close the sentence.
        size = new.astype(np.int64) + (pe - ps) + last_piece + (SPAN - 1) * ends
        at = np.cumsum(size) - size + new
        self.codes = np.zeros(int(size.sum()), np.uint8)
        self.codes[at[new] - 1] = _SPACE
        length = pe - ps
        where = np.repeat(at, length) + np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        self.codes[where] = sym[np.repeat(ps, length) + np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)]
        self.codes[(at + length)[last_piece]] = _SPACE
        self.start, self.end = at - 1, at + length

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and row of all windows: one to ``MOST_WORDS`` words of a sentence."""
        starts, ends, rows = [], [], []
        for n in range(MOST_WORDS):
            m = max(len(self.start) - n, 0)
            i = np.flatnonzero(self.sentence[:m] == self.sentence[n : n + m]) if m else np.zeros(0, int)
            starts.append(self.start[i])
            ends.append(self.end[i + n])
            rows.append(self.row[i])
        return np.concatenate(starts), np.concatenate(ends), np.concatenate(rows)


def triples(codes: np.ndarray):
    """For each pair of gaps: the number of the subsequence that starts at each place, and its weight."""
    c = np.concatenate([codes.astype(np.int32), np.zeros(SPAN, np.int32)])
    n = len(codes)
    for d2 in range(2, SPAN):
        outer = c[:n] << (2 * _BITS) | c[d2 : d2 + n]
        outer[(c[:n] == 0) | (c[d2 : d2 + n] == 0)] = 0
        for d1 in range(1, d2):
            middle = c[d1 : d1 + n]
            yield np.where((outer > 0) & (middle > 0), outer | middle << _BITS, 0), LAMBDA ** (d2 + 1)


def norms(length: np.ndarray) -> np.ndarray:
    """The norm of a window of so many places, counting its occurrences as distinct."""
    each = math.sqrt(sum((d2 - 1) * LAMBDA ** (2 * (d2 + 1)) for d2 in range(2, SPAN)))
    return each * np.sqrt(np.maximum(length, SHORTEST))


def kernel(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """The kernel between two lists of windows: symbols with ``SPAN - 1`` following ones."""
    found = [np.unique(np.concatenate([k[: max(len(w) - SPAN + 1, 0)] for k, _ in triples(np.frombuffer(w, np.uint8))])) for w in right]
    numbers = np.unique(np.concatenate(found))
    numbers = numbers[numbers > 0]
    column = np.full(SYMBOLS**3, -1, np.int32)
    column[numbers] = np.arange(len(numbers))

    def dense(windows: list[bytes]) -> np.ndarray:
        m = np.zeros(len(windows) * len(numbers), np.float32)
        size = np.array([len(w) for w in windows])
        codes = np.frombuffer(b"".join(windows), np.uint8)
        which = np.repeat(np.arange(len(windows)), size)
        offs = np.cumsum(size) - size
        inside = np.arange(len(codes)) - offs[which] < size[which] - SPAN + 1
        for k, weight in triples(codes):
            ok = np.flatnonzero(inside & (column[k] >= 0))
            np.add.at(m, which[ok] * len(numbers) + column[k[ok]], np.float32(weight))
        return m.reshape(len(windows), len(numbers)) / norms(size - SPAN + 1)[:, None].astype(np.float32)

    other = dense(right)
    return np.concatenate([dense(left[i : i + 256]) @ other.T for i in range(0, len(left), 256)]).astype(np.float64) if left else np.zeros((0, len(right)))


class SubsequenceMachine:
    """The collapsed machine: a weight for each subsequence, and the logistic step."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights.astype(np.float32), bias
        self.mean, self.scale, self.logit = np.zeros(3), np.ones(3), np.zeros(4)

    def window_scores(self, text: Sentences) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Start, end, row and score of all windows."""
        per = np.zeros(len(text.codes), np.float32)
        for k, weight in triples(text.codes):
            per += self.weights[k] * np.float32(weight)
        sums = np.concatenate([[0], np.cumsum(per, dtype=np.float64)])
        start, end, row = text.windows()
        return start, end, row, (sums[end] - sums[start]) / norms(end - start) + self.bias

    def row_inputs(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Largest window score, summed positive scores, and the share of positive windows of each row."""
        return self.inputs_of(*self.window_scores(Sentences(buf, offs)), len(offs) - 1)

    @staticmethod
    def inputs_of(start: np.ndarray, end: np.ndarray, row: np.ndarray, f: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros((n, 3))
        out[:, 0] = -3.0
        if len(f):
            # Windows that occur again count once; equal scores of equal lengths are taken for equal windows.
            key = np.stack([row, np.round(f * 1e5).astype(np.int64) * 4096 + np.minimum(end - start, 4095)])
            order = np.lexsort(key[::-1])
            first = np.ones(len(order), bool)
            first[1:] = (key[:, order[1:]] != key[:, order[:-1]]).any(axis=0)
            row, f = row[order[first]], f[order[first]]
            np.maximum.at(out[:, 0], row, f)
            count = np.bincount(row, minlength=n)
            out[:, 1] = np.log1p(np.bincount(row, np.maximum(f, 0), minlength=n))
            out[:, 2] = np.bincount(row, f > 0, minlength=n) / np.maximum(count, 1)
        return np.clip(out, -3, 10)

    def probability(self, inputs: np.ndarray) -> np.ndarray:
        z = (inputs - self.mean) / self.scale @ self.logit[:3] + self.logit[3]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def calibrate(self, inputs: np.ndarray, labels: np.ndarray, ridge: float = 1e-2) -> None:
        """Logistic regression by Newton's method."""
        self.mean, self.scale = inputs.mean(axis=0), inputs.std(axis=0) + 1e-6
        x = np.c_[(inputs - self.mean) / self.scale, np.ones(len(inputs))]
        w = np.zeros(4)
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            grad = x.T @ (p - labels) + ridge * w
            w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(4), grad)
        self.logit = w


def train_svm(z: np.ndarray, y: np.ndarray, weight: np.ndarray, reg: float = 1e-3, steps: int = 400) -> tuple[np.ndarray, float]:
    """A linear SVM with squared hinge loss by accelerated gradient descent."""
    x = np.c_[z, np.ones(len(z))]
    weight = weight / weight.sum()
    bound = 2 * float(np.linalg.norm((x * np.sqrt(weight)[:, None]), 2) ** 2) + reg
    w = v = np.zeros(x.shape[1])
    for t in range(steps):
        slack = np.maximum(0, 1 - y * (x @ v))
        grad = -2 * x.T @ (weight * y * slack) + reg * np.r_[v[:-1], 0]
        new = v - grad / bound
        v = new + t / (t + 3) * (new - w)
        w = new
    return w[:-1], float(w[-1])


def _evenly(items: list[bytes], n: int) -> list[bytes]:
    """``n`` of the items, evenly along the list."""
    return [items[i] for i in np.unique(np.linspace(0, len(items) - 1, min(n, len(items))).astype(int))] if items else []


def fit_windows(positive: list[bytes], negative: list[bytes], landmarks: int = LANDMARKS) -> SubsequenceMachine:
    """A machine that tells toxic windows from others, each list from the most toxic down."""
    marks = _evenly(list(dict.fromkeys(positive)), landmarks // 2)
    others = list(dict.fromkeys(negative))
    marks = list(dict.fromkeys([*marks, *others[: landmarks // 4], *_evenly(others, landmarks // 4)]))
    gram = kernel(marks, marks)
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    good = values > 1e-4 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    z = kernel([*positive, *negative], marks) @ root
    y = np.r_[np.ones(len(positive)), -np.ones(len(negative))]
    w, bias = train_svm(z, y, np.r_[np.full(len(positive), 1 / len(positive)), np.full(len(negative), 1 / len(negative))])
    beta = root @ w
    weights = np.zeros(SYMBOLS**3)
    for mark, b in zip(marks, beta):
        n = len(mark) - SPAN + 1
        for k, weight in triples(np.frombuffer(mark, np.uint8)):
            np.add.at(weights, k[:n], b / norms(np.array([n]))[0] * weight)
    weights[0] = 0
    return SubsequenceMachine(weights, bias)


def _windows_of(text: Sentences) -> list[bytes]:
    """The distinct windows of a text: their symbols with the ``SPAN - 1`` following places, of which only a space is kept."""
    start, end, _ = text.windows()
    raw = text.codes.tobytes()
    return sorted({(raw[s:e] + raw[e : e + 1]).ljust(e - s + SPAN - 1, b"\0") for s, e in zip(start.tolist(), end.tolist())})


def _first_ranking(rows: DataFrame, toxic: int, total: int) -> dict[bytes, float]:
    """Windows that stand in toxic documents beyond chance, with the log-likelihood ratio of that."""

    def cut(batches):
        lean_worker()
        for batch in batches:
            buf, offs = text_bytes(batch.column(2))
            for a, b, y in zip(offs[:-1].tolist(), offs[1:].tolist(), batch.column(1).to_pylist()):
                found = _windows_of(Sentences(buf[a:b], np.array([0, b - a])))
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array([y] * len(found), pa.int32())], names=["w", "y"])

    base = toxic / total
    counts = rows.mapInArrow(cut, "w binary, y int").groupBy("w").agg(F.sum("y").alias("t"), F.count(F.lit(1)).alias("n")).where("t >= 3")
    t, n = F.col("t"), F.col("n")
    ratio = t * F.log(t / n / base) + F.when(t < n, (n - t) * F.log((1 - t / n) / (1 - base))).otherwise(0.0)
    found = counts.where(t / n > base).select("w", ratio.alias("score")).where(F.col("score") > SURE)  # of at most max_train documents
    return {bytes(r["w"]): r["score"] for r in found.collect()}


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, held: int = 0, max_train: int = MAX_TRAIN, doc_id: str = "doc_id", text: str = "text") -> SubsequenceMachine | None:
    """A machine fitted outside the held-out fold; None without labelled rows of both kinds.

    At most ``max_train`` labelled documents are used, the least by a hash of doc_id; of a repeated
    doc_id the least text counts, a null text as empty.  The driver sees ``TOP`` windows of each.
    """
    chosen = training_rows(labels, label, folds, held, max_train)
    toxic = sum(y for _, y in chosen)
    if not toxic or toxic == len(chosen):
        return None
    spark = docs.sparkSession
    wanted = F.broadcast(spark.createDataFrame(chosen, "_id long, y int"))  # at most max_train rows
    rows = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("text")).join(wanted, "_id").groupBy("_id", "y").agg(F.min("text").alias("text"))
    rows = materialize(rows.repartition(spark.sparkContext.defaultParallelism), "labelled")

    def each(work, schema: str) -> list[dict]:
        """``work`` on the sentences of every labelled document, in the order of doc_id and result."""

        def run(batches):
            lean_worker()
            for batch in batches:
                buf, offs = text_bytes(batch.column(2))
                out = [work(Sentences(buf[a:b], np.array([0, b - a]))) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())]
                kinds = [pa.list_(pa.binary()), pa.list_(pa.float64()), pa.list_(pa.float64())]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([o[i] for o in out], k) for i, k in enumerate(kinds))], names=["_id", "y", "windows", "scores", "inputs"])

        got = rows.mapInArrow(run, schema).toArrow().to_pylist()
        return sorted(got, key=lambda r: (r["_id"], r["windows"], r["inputs"]))

    def ranked(best, schema="_id long, y int, windows array<binary>, scores array<double>, inputs array<double>") -> list[dict]:
        shared = spark.sparkContext.broadcast(best)

        def by_table(text: Sentences):
            """The best windows by the first ranking; of equal ones those with the least checksum."""
            found = sorted((-shared.value.get(w, 0.0), zlib.crc32(w), w) for w in _windows_of(text))[:TOP]
            return [w for *_, w in found], [-s for s, *_ in found], []

        def by_machine(text: Sentences):
            """The best windows that do not overlap, and the document's inputs."""
            start, end, row, f = shared.value.window_scores(text)
            raw = text.codes.tobytes()
            windows: dict[bytes, float] = {}
            free = np.ones(len(raw) + 1, bool)
            for i in np.lexsort((start, end - start, -f))[: 8 * TOP].tolist():
                if free[start[i] + 1 : end[i]].all() and len(windows) < TOP:
                    free[start[i] : end[i]] = False
                    windows.setdefault(raw[start[i] : end[i]] + (raw[end[i] : end[i] + SPAN - 1]).ljust(SPAN - 1, b"\0"), float(f[i]))
            return list(windows), list(windows.values()), shared.value.inputs_of(start, end, row, f, 1)[0].tolist()

        out = each(by_table if isinstance(best, dict) else by_machine, schema)
        shared.destroy()
        return out

    best, others = _first_ranking(rows, toxic, len(chosen)), dict[bytes, float]()
    for _ in range(ROUNDS):
        found = ranked(best)
        least = SURE if isinstance(best, dict) else 0.0
        positive = sorted(((s, w) for r in found if r["y"] for s, w in zip(r["scores"], r["windows"]) if s > least), reverse=True)
        others.update((w, s) for r in found if not r["y"] for s, w in zip(r["scores"], r["windows"]))
        if not positive or not others:
            break
        best = fit_windows([w for _, w in positive], sorted(others, key=lambda w: (-others[w], w)))
    if isinstance(best, dict):
        return None
    machine = best
    found = ranked(machine)
    machine.calibrate(np.array([r["inputs"] for r in found]), np.array([r["y"] for r in found], float))
    return machine


def score_toxicity(docs: DataFrame, machine: SubsequenceMachine | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score (probability of label 1) and predicted for every document.

    Null and empty texts get the score of a text without words.  Without a machine every score is 0.
    One row for each input row, repeated and null doc_ids included; other columns are not read.
    A text may be of any length, and is read whole; equal texts have equal scores.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # eight megabytes at any input

    def work(batches):
        lean_worker()
        svm = shared.value
        for batch in batches:
            buf, offs = text_bytes(batch.column(1))
            out = []
            for a, b in row_blocks(offs):
                out.append(np.zeros(b - a) if svm is None else svm.probability(svm.row_inputs(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a])))
            score = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(work, "doc_id long, score double, predicted int")
