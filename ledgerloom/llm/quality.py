"""Quality scores from a factorisation machine (Rendle, 2010).

Inputs are hashed words and structure statistics of the text (shares of capitals, digits, marks,
repeats, lengths), each statistic cut into quantile bins.  The machine adds to a linear model the
pairwise interactions of all inputs through low-rank factors, scored in linear time by
1/2 * sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2].

It is fitted on at most ``max_train`` labelled rows (the least by a hash of doc_id); scoring is a
map over all documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NOT_SPACE, lean_worker, row_blocks, sorted_pairs, text_bytes, word_spans

BUCKETS = 1 << 12
BINS = 24
RANK = 8
MAX_TRAIN = 6000

_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_MARK = ~(_LETTER | _DIGIT | ~NOT_SPACE)
_MARK[[0, 44, 46]] = False
STATISTICS = 12


def _per_row(mask: np.ndarray, offs: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return (sums[offs[1:]] - sums[offs[:-1]]).astype(np.float64)


def features(buf: np.ndarray, offs: np.ndarray):
    """Rows, buckets and weights of the words (each row's weights have norm 1), and the statistics."""
    n = len(offs) - 1
    starts, ends, rows, h = word_spans(buf, offs)
    words = np.bincount(rows, minlength=n).astype(float)
    r, v, c = sorted_pairs(rows, h)
    distinct = np.bincount(r, minlength=n)
    most = np.zeros(n)
    np.maximum.at(most, r, c)
    again = np.bincount(rows[1:][(h[1:] == h[:-1]) & (rows[1:] == rows[:-1])], minlength=n) if len(h) else np.zeros(n)
    size = np.diff(offs).astype(float)
    length = (ends - starts).astype(float)
    total_length = np.bincount(rows, length, minlength=n)
    squares = np.bincount(rows, length * length, minlength=n)
    per_byte, per_word = 1 / np.maximum(size, 1), 1 / np.maximum(words, 1)
    mean_length = total_length * per_word
    stats = np.stack(
        [
            _per_row(_CAPITAL[buf], offs) * per_byte,
            _per_row(_DIGIT[buf], offs) * per_byte,
            _per_row(_MARK[buf], offs) * per_byte,
            _per_row(buf == 10, offs) * per_byte,
            _per_row(buf >= 128, offs) * per_byte,
            _per_row(buf == 46, offs) * per_word,
            distinct * per_word,
            most * per_word,
            again * per_word,
            mean_length,
            np.sqrt(np.maximum(squares * per_word - mean_length**2, 0)),
            np.log1p(words),
        ],
        axis=1,
    )
    weight = np.log1p(c.astype(float))
    norm = np.sqrt(np.bincount(r, weight * weight, minlength=n))
    return r, (v % np.uint64(BUCKETS)).astype(np.int64), weight / np.maximum(norm[r], 1e-9), stats


class FactorisationMachine:
    def __init__(self, edges: np.ndarray, bias: float, linear: np.ndarray, factors: np.ndarray):
        self.edges, self.bias, self.linear, self.factors = edges, bias, linear, factors

    def inputs(self, buf: np.ndarray, offs: np.ndarray):
        """All inputs as (row, column, value), sorted by row."""
        r, k, x, stats = features(buf, offs)
        n = len(offs) - 1
        bins = np.stack([np.searchsorted(self.edges[j], stats[:, j], "right") for j in range(STATISTICS)], axis=1) if n else np.zeros((0, STATISTICS), int)
        cols = BUCKETS + np.arange(STATISTICS) * BINS + bins
        row = np.concatenate([r, np.repeat(np.arange(n), STATISTICS)])
        col = np.concatenate([k, cols.reshape(-1)])
        val = np.concatenate([x, np.full(n * STATISTICS, 0.5)])
        return row, col, val

    def score(self, row: np.ndarray, col: np.ndarray, val: np.ndarray, n: int) -> np.ndarray:
        """Probabilities of label 1."""
        z = np.full(n, self.bias) + np.bincount(row, self.linear[col] * val, minlength=n)
        for f in range(self.factors.shape[1]):
            vx = self.factors[col, f] * val
            z += 0.5 * (np.bincount(row, vx, minlength=n) ** 2 - np.bincount(row, vx * vx, minlength=n))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    @classmethod
    def fit(cls, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 30, rank: int = RANK, rate: float = 0.05, decay: float = 1e-4, seed: int = 7) -> FactorisationMachine:
        """AdaGrad on the log loss.  ``parts``: buckets, weights and statistics of each row."""
        stats = np.stack([s for _, _, s in parts])
        grid = np.linspace(0, 1, BINS + 1)[1:-1]
        edges = np.stack([np.quantile(stats[:, j], grid) for j in range(STATISTICS)])
        rng = np.random.default_rng(seed)
        width = BUCKETS + STATISTICS * BINS
        share = float(np.clip(labels.mean(), 0.01, 0.99))
        fm = cls(edges, float(np.log(share / (1 - share))), np.zeros(width), rng.normal(0, 0.02, (width, rank)))
        rows = []
        for k, x, s in parts:
            bins = [np.searchsorted(edges[j], s[j], "right") + BUCKETS + j * BINS for j in range(STATISTICS)]
            rows.append((np.concatenate([k, bins]).astype(np.int64), np.concatenate([x, np.full(STATISTICS, 0.5)])))
        gl, gv, gb = np.full(width, 1e-8), np.full((width, rank), 1e-8), 1e-8
        for _ in range(epochs):
            for batch in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // 64)):
                col = np.concatenate([rows[i][0] for i in batch])
                val = np.concatenate([rows[i][1] for i in batch])
                row = np.repeat(np.arange(len(batch)), [len(rows[i][0]) for i in batch])
                error = (fm.score(row, col, val, len(batch)) - labels[batch]) / len(batch)
                used, inverse = np.unique(col, return_inverse=True)
                e = error[row] * val
                step = np.bincount(inverse, e, minlength=len(used)) + decay * fm.linear[used]
                gl[used] += step * step
                fm.linear[used] -= rate * step / np.sqrt(gl[used])
                total = error.sum()
                gb += total * total
                fm.bias -= rate * total / np.sqrt(gb)
                for f in range(rank):
                    v = fm.factors[col, f]
                    sums = np.bincount(row, v * val, minlength=len(batch))
                    step = np.bincount(inverse, e * (sums[row] - v * val), minlength=len(used)) + decay * fm.factors[used, f]
                    gv[used, f] += step * step
                    fm.factors[used, f] -= rate * step / np.sqrt(gv[used, f])
        return fm


def label_fold(doc_id: str | Column, folds: int) -> Column:
    """crc32 of the doc_id as text modulo ``folds``; null for a null doc_id."""
    return F.crc32(F.encode((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string"), "UTF-8")) % folds


def training_rows(labels: DataFrame, label: str, folds: int, held: int, most: int, doc_id: str = "doc_id") -> list[tuple[int, int]]:
    """At most ``most`` (doc_id, label) outside the held-out fold; a doc_id with both labels is left out."""
    own = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & (label_fold("doc_id", folds) != held))
    one = own.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("y2")).where("y = y2")
    return [(r["doc_id"], r["y"]) for r in one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select("doc_id", "y").collect()]


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 3, held: int = 1, max_train: int = MAX_TRAIN, doc_id: str = "doc_id", text: str = "text") -> FactorisationMachine | None:
    """A machine fitted outside the held-out fold, or None if no labelled row is left there.

    At most ``max_train`` labelled documents are used, the least by a hash of doc_id; of a repeated
    doc_id the least text counts, a null text as empty.  Texts may be of any length.
    """
    chosen = training_rows(labels, label, folds, held, max_train)
    if not chosen:
        return None
    spark = docs.sparkSession
    wanted = F.broadcast(spark.createDataFrame(chosen, "_id long, y int"))  # at most max_train rows
    rows = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("text")).join(wanted, "_id").groupBy("_id", "y").agg(F.min("text").alias("text"))

    def work(batches):
        for batch in batches:
            buf, offs = text_bytes(batch.column(2))
            for a, b in row_blocks(offs):
                r, k, x, stats = features(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                cut = np.searchsorted(r, np.arange(b - a + 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        batch.column(1).slice(a, b - a),
                        pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(k.astype(np.int32))),
                        pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(x)),
                        pa.array(list(stats), pa.list_(pa.float64())),
                    ],
                    names=["_id", "y", "k", "x", "s"],
                )

    got = rows.mapInArrow(work, "_id long, y int, k array<int>, x array<double>, s array<double>").toArrow()  # at most max_train rows
    if not got.num_rows:
        return None
    got = got.combine_chunks()
    k, x, s, ids = (got.column(c).combine_chunks() for c in ("k", "x", "s", "_id"))
    parts = [(k[i].values.to_numpy(), x[i].values.to_numpy(), s[i].values.to_numpy()) for i in range(got.num_rows)]
    order = sorted(range(len(parts)), key=lambda i: (ids[i].as_py(), len(parts[i][0]), tuple(parts[i][2])))  # as tasks end in any order
    return FactorisationMachine.fit([parts[i] for i in order], got.column("y").to_numpy()[order].astype(float))


def score_quality(docs: DataFrame, machine: FactorisationMachine | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score (probability of label 1) and predicted for every document.

    Null and empty texts are scored as texts without words.  Without a machine every score is 0.5.
    One row for each input row, repeated and null doc_ids included; other columns are not read.
    A text may be of any length, and is read whole; equal texts have equal scores.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # a few hundred kilobytes at any input

    def work(batches):
        lean_worker()
        fm = shared.value
        for batch in batches:
            buf, offs = text_bytes(batch.column(1))
            out = []
            for a, b in row_blocks(offs):
                out.append(np.full(b - a, 0.5) if fm is None else fm.score(*fm.inputs(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a]), b - a))
            score = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(work, "doc_id long, score double, predicted int")


def keep_quality(docs: DataFrame, machine: FactorisationMachine | None, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """The rows whose score reaches ``threshold``, with all their columns; without a machine all rows stay.

    Null and empty texts are scored as texts without words; a score equal to the threshold stays;
    repeated rows and null ids are rows like others; an empty table gives no rows.
    """
    if machine is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    at = docs.columns.index(text)

    def work(batches):
        lean_worker()
        fm = shared.value
        for batch in batches:
            buf, offs = text_bytes(batch.column(at))
            out = [fm.score(*fm.inputs(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a]), b - a) for a, b in row_blocks(offs)]
            if out:
                yield batch.filter(pa.array(np.concatenate(out) >= threshold))

    return docs.mapInArrow(work, docs.schema)
