"""Runs of repeated words by string synchronising sets.

A run is a stretch of words with a smallest period q, at least four periods long, that no neighbour
extends.  Each task looks at many whole texts at once as one sequence of word hashes, every text
closed by a value of its own, so that nothing that reaches across an end equals anything else.

At the scale t = 1, 2, 4, ... windows of t words have identifiers (hashes put together from those of
half the length).  A position i is a synchroniser if the least identifier of the windows at i to
i + t is that at i or at i + t.  Windows with a period of at most t / 4 are left out of the choice.
Whether i is chosen depends on the 2t words from i only, so equal stretches are cut alike, and in each
t neighbouring positions one is chosen, unless 3t - 1 words there have a period of at most t / 4.
Those highly periodic regions are runs of the scales below: they are known when a scale begins.

A run of period q, t <= q < 2t, holds q + 3t words and no such region (its period would be smaller),
hence a synchroniser whose 2t words come again exactly q further, and not sooner.  So neighbours in
the order of (2t words, position) that lie t to 2t - 1 apart propose all periods; each proposal is
extended word by word and kept if it is long enough.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean_worker, mix64, row_blocks, text_bytes, word_spans

_LEFT = np.uint64(0xD6E8FEB86659FD93)
_FAR = np.uint64(2**64 - 1)
#: Bytes of texts that a task looks at together; a longer text is looked at alone.
TOGETHER = 4 << 20


def _least(x: np.ndarray, k: int) -> np.ndarray:
    """The least of each k neighbours of ``x``: prefixes and suffixes of blocks of k."""
    n = len(x)
    full = np.full(-(-n // k) * k, _FAR)
    full[:n] = x
    blocks = full.reshape(-1, k)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - k + 1], ahead[k - 1 : n])


def _same_until(words: np.ndarray, i: int, d: int) -> int:
    """The first j >= i where the words at j and j + d differ."""
    step, end = 32, len(words) - d
    while i < end:
        part = words[i : min(i + step, end)] != words[i + d : min(i + step, end) + d]
        at = int(part.argmax())
        if part[at]:
            return i + at
        i, step = i + len(part), step * 2
    return end


def _same_since(words: np.ndarray, i: int, d: int) -> int:
    """The least j <= i so that the words from j to i - 1 equal those d further."""
    step = 32
    while i > 0:
        a = max(0, i - step)
        part = (words[a:i] != words[a + d : i + d])[::-1]
        at = int(part.argmax())
        if part[at]:
            return i - at
        i, step = a, step * 2
    return 0


def word_runs(hashes: np.ndarray, ends: np.ndarray, times: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and smallest period of all runs of at least ``times`` periods, by start and period.

    ``hashes`` are those of the words of all texts, ``ends`` the number of words up to the end of each
    text.  Starts count from the first word of all.
    """
    if times < 4:
        raise ValueError("runs of fewer than four periods may have no synchroniser")
    lengths = np.diff(ends, prepend=0)
    text = np.repeat(np.arange(len(ends)), lengths)
    at = np.arange(len(hashes)) + text  # a closing value behind each text
    words = np.empty(len(hashes) + len(ends), np.uint64)
    words[at] = hashes
    words[ends + np.arange(len(ends))] = mix64(np.arange(len(ends), dtype=np.uint64) + np.uint64(1 << 62))
    room = np.repeat(lengths, lengths + 1)  # words of the text at each position
    place = np.arange(len(words))  # where a position that is still looked at lies in ``words``
    ids, t, found = words, 1, {}
    while 4 * t <= lengths.max(initial=0):
        if 2 * np.count_nonzero(room >= 4 * t) <= len(room):  # only texts that can hold such runs
            keep = room >= 4 * t
            ids, place, room = ids[keep], place[keep], room[keep]
        n = len(ids)
        contexts = mix64(ids * _LEFT + np.uint64(t))
        contexts[: n - t] ^= ids[t:]
        contexts[n - t :] ^= place[n - t :].astype(np.uint64) + np.uint64(1 << 61)  # beyond the end: alone
        contexts = mix64(contexts)
        if n > 2 * t:
            choice = ids.copy()
            cover = np.zeros(n + 1, np.int32)
            for (s, d), size in found.items():
                if 4 * d <= t and size >= t:
                    a = int(np.searchsorted(place, s))
                    if a < n and place[a] == s:
                        cover[a] += 1
                        cover[a + size - t + 1] -= 1
            if found:
                choice[np.cumsum(cover[:n]) > 0] = _FAR
            least = _least(choice, t + 1)
            chosen = np.flatnonzero(((least == choice[: n - t]) | (least == choice[t:])) & (least != _FAR))
            bits = np.uint64(n.bit_length())
            order = np.sort((contexts[chosen] >> bits << bits) | chosen.astype(np.uint64))
            spot = (order & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
            apart = np.diff(spot)
            near = np.flatnonzero((apart >= t) & (apart < 2 * t) & (order[1:] >> bits == order[:-1] >> bits))
            _extend(words, place[spot[near]], apart[near], 2 * t, times, found)
        ids, t = contexts, 2 * t
    runs = sorted((s, d, size) for (s, d), size in found.items())
    if not runs:
        return (np.zeros(0, np.int64),) * 3
    start, period, size = (np.array(x, np.int64) for x in zip(*runs))
    closed = ends + np.arange(len(ends))
    return start - np.searchsorted(closed, start, "right"), size, period


def _extend(words: np.ndarray, spots: np.ndarray, periods: np.ndarray, reach: int, times: int, found: dict) -> None:
    """Add the runs of the proposals (position, period), one proposal for each stretch of them."""
    order = np.lexsort((spots, periods))
    spots, periods = spots[order], periods[order]
    first = np.ones(len(spots), bool)
    first[1:] = (np.diff(periods) != 0) | (np.diff(spots) > reach)
    for i, d in zip(spots[first].tolist(), periods[first].tolist()):
        start = _same_since(words, i, d)
        size = _same_until(words, i, d) + d - start
        if size >= times * d and all((start, q) not in found or found[start, q] != size for q in range(1, d) if d % q == 0):
            found[start, d] = size


def _without(buf: np.ndarray, offs: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray, keep: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by one space."""
    starts, ends, row = starts[keep], ends[keep], row[keep]
    out = np.append(buf, np.uint8(0))
    inner = np.ones(len(row), bool)  # another word of the text follows, so there is white space behind
    if len(row):
        inner[:-1] = row[1:] == row[:-1]
        inner[-1] = False
    out[ends[inner]] = 32
    step = np.zeros(len(out) + 1, np.int8)
    step[starts] += 1
    step[ends + inner] -= 1
    mask = np.cumsum(step[: len(buf)], dtype=np.int8).astype(bool)
    cuts = np.zeros(len(buf) + 1, np.int32)
    np.cumsum(mask, out=cuts[1:])
    return pa.StringArray.from_buffers(len(offs) - 1, pa.py_buffer(np.ascontiguousarray(cuts[offs])), pa.py_buffer(out[: len(buf)][mask]))


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def find_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", times: int = 4, shortest: int = 6) -> DataFrame:
    """The runs of repeated words of every text, and the text without their repeats.

    Words are ``[^\\x20\\x09-\\x0D]+`` as they are written, numbered from 0.  ``runs`` holds start, length
    and smallest period of each run of at least ``times`` (4 or more) periods and ``shortest`` words, by
    start and period; ``collapsed`` the words that no run contains behind its first period, joined by one
    space.  Words are told apart by 64-bit hashes within their text.  One row for each input row,
    repeated and null ids included; null and empty texts have no words, no runs and an empty text left.
    Columns: doc_id, runs, collapsed; others are not read.  No shuffle; a text is looked at as a whole,
    in some 150 bytes for each word.
    """

    def work(batches):
        lean_worker("periodic")
        for batch in batches:
            all_bytes, all_offs = text_bytes(batch.column(1))
            for a, b in row_blocks(all_offs, TOGETHER):
                buf, offs = all_bytes[all_offs[a] : all_offs[b]], all_offs[a : b + 1] - all_offs[a]
                starts, ends, row, hashes = word_spans(buf, offs, lower=False)
                upto = np.searchsorted(row, np.arange(b - a), "right")
                start, size, period = word_runs(hashes, upto, times)
                long = size >= shortest
                start, size, period = start[long], size[long], period[long]
                covered = np.zeros(len(hashes) + 1, np.int64)
                np.add.at(covered, start + period, 1)
                np.add.at(covered, start + size, -1)
                kept = np.cumsum(covered[:-1]) == 0
                of = row[start]
                lists = pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(of, np.arange(b - a + 1)), pa.int32()),
                    pa.StructArray.from_arrays([pa.array(start - np.append(0, upto)[of]), pa.array(size), pa.array(period)], fields=list(RUN)),
                )
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists, _without(buf, offs, starts, ends, row, kept)], names=["doc_id", "runs", "collapsed"])

    schema = "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(work, schema)
