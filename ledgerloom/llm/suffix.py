"""Repeated byte strings across a corpus, by distributed prefix doubling.

Documents are written once in document order, cut into *blocks* of consecutive documents; a
position is (block, byte), so positions order as the documents do.  Then:

1. *Length 32, sampled.*  Any ``threshold`` bytes hold an anchor: the place where the ``BASE``-byte
   prefix has the least fingerprint.  Equal strings have their anchor at the same offset, so
   consecutive string starts with one anchor form a *run*, and anchors are sorted first.  A run
   whose anchor prefix is unique holds no repeat and leaves; one whose bytes all came before is a
   repeat as a whole; the starts of the others are *open*.
2. *Length 64.*  The prefixes at all positions that open starts need are sorted and numbered.
3. *Doubling.*  Pairs (rank here, rank ``offset`` further on) are sorted and numbered again, at
   offsets 64, 128, ... until they cover ``threshold`` bytes (at 100 bytes once, 36 further on).
   Positions that have become unique leave before every round, and with them all starts whose
   string holds one.
4. Starts whose ``threshold``-byte rank also stands at an earlier position are repeats.

What Spark shuffles are packed arrays: for each block and range of keys the block's distinct
pairs, and back their ranks.  A string that a third of all rows share is sent once by each block,
so no group grows with its copies.  Ranges and blocks are sized in bytes.  Whole runs are told
apart by 128 bits of fingerprint, names of 64 bytes by 96; all later ranks are exact.

Sorting every byte's position instead would shuffle about 16 bytes for each byte and round.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _TABLE, clear_path, fresh_name, lean_worker, materialize, mix64, powers, text_bytes

BASE = 32
SEGMENT = 1 << 18
#: Bytes of text in a block, and bytes of text for which there is one range of keys: the least and the most.
BLOCK_BYTES = 8 << 20, 64 << 20
RANGE_BYTES = 4 << 20, 128 << 20
#: One message: from a block to a range of keys (kind ``ask``, ``run``), back (``rank``), or a block's own (``state``, ``repeat``, ``open``).
MESSAGE = "kind string, block long, place long, a binary, b binary, c binary, d binary"
_TYPES = [("kind", pa.string()), ("block", pa.int64()), ("place", pa.int64()), *((c, pa.binary()) for c in "abcd")]
_SECOND = np.random.Generator(np.random.PCG64(20260202)).integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def _row(kind: str, block: int, place: int, *parts: np.ndarray) -> dict:
    return {"kind": kind, "block": block, "place": place} | {c: p.tobytes() for c, p in zip("abcd", parts)}


def _table(rows: list[dict]) -> pa.Table:
    lean_worker()
    return pa.table({name: pa.array([r.get(name) for r in rows], kind) for name, kind in _TYPES})


def _ints(data: bytes | None, kind: str = "<u4") -> np.ndarray:
    return np.frombuffer(data or b"", kind)


def doubling_lengths(threshold: int) -> list[int]:
    """The lengths at which positions are ranked: a base, its doubles, the threshold."""
    length = min(2 * BASE, threshold)
    out = [length]
    while length < threshold:
        length = min(2 * length, threshold)
        out.append(length)
    return out


# Fingerprints -------------------------------------------------------------------------------------


def _prints(part: np.ndarray, table: np.ndarray = _TABLE) -> tuple[np.ndarray, np.ndarray]:
    """Running sums for fingerprints of any stretch, and the factors that align them."""
    p, inverse = powers(len(part) + 1)
    sums = np.zeros(len(part) + 1, np.uint64)
    np.cumsum(table[part] * p[: len(part)], out=sums[1:])
    return sums, inverse


def runs(buf: np.ndarray, doc_end: np.ndarray, threshold: int):
    """Start, length, anchor name and two content names of each run of string starts.

    ``doc_end`` holds for each document its end in ``buf``, in order.
    """
    prefix = min(BASE, threshold)
    window = threshold - prefix + 1
    out = []
    for s in range(0, len(buf), SEGMENT):
        part = buf[s : s + SEGMENT + threshold - 1]
        n = len(part)
        starts = min(SEGMENT, n - threshold + 1)
        if starts <= 0:
            break
        sums, inverse = _prints(part)
        names = mix64((sums[prefix:] - sums[: n - prefix + 1]) * inverse[: n - prefix + 1])
        least = (names & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(names), dtype=np.uint64)
        width = 1
        while 2 * width <= window:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if window > width:
            least = np.minimum(least[: len(least) - (window - width)], least[window - width :])
        anchor = (least[:starts] & np.uint64(0xFFFFFF)).astype(np.int64)
        at = np.arange(starts)
        end = doc_end[np.searchsorted(doc_end, at + s, "right")]
        whole = at + s + threshold <= end
        first = whole.copy()
        first[1:] &= ~whole[:-1] | (anchor[1:] != anchor[:-1]) | (end[1:] != end[:-1])
        last = whole.copy()
        last[:-1] &= ~whole[1:] | first[1:]
        a, b = np.flatnonzero(first), np.flatnonzero(last)
        x = anchor[a]
        shape = (b - a).astype(np.uint64) << np.uint64(32) | (x - a).astype(np.uint64)
        content = mix64(mix64((sums[b + threshold] - sums[a]) * inverse[a]) + shape)
        sums, inverse = _prints(part, _SECOND)
        second = mix64((sums[b + threshold] - sums[a]) * inverse[a] + shape)
        out.append((a + s, b - a + 1, mix64(names[x]), content, second))  # least values: mixed again, they spread evenly
    if not out:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64, np.uint64))
    return tuple(np.concatenate([o[i] for o in out]) for i in range(5))


def base_names(buf: np.ndarray, places: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two names of the ``length`` bytes at each place (ascending)."""
    out = np.zeros((2, len(places)), np.uint64)
    cut = np.searchsorted(places, np.arange(0, len(buf) + SEGMENT, SEGMENT))
    for k, (i, j) in enumerate(zip(cut[:-1], cut[1:])):
        if i < j:
            s = k * SEGMENT
            at = places[i:j] - s
            for row, table in enumerate((_TABLE, _SECOND)):
                sums, inverse = _prints(buf[s : s + SEGMENT + length], table)
                out[row, i:j] = mix64((sums[at + length] - sums[at]) * inverse[at])
    return out[0], out[1]


# Packed positions ---------------------------------------------------------------------------------


def _spread(place: np.ndarray, length: np.ndarray) -> np.ndarray:
    """All positions of stretches (place, length)."""
    return np.repeat(place, length) + np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)


def _stretches(positions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending positions as stretches (place, length)."""
    if not len(positions):
        return np.zeros(0, "<u4"), np.zeros(0, "<u4")
    first = np.flatnonzero(np.diff(positions, prepend=-2) != 1)
    return positions[first].astype("<u4"), np.diff(np.append(first, len(positions))).astype("<u4")


def _first_of(*keys: np.ndarray) -> np.ndarray:
    """Whether each entry of sorted keys differs from the one before."""
    first = np.ones(len(keys[0]), bool)
    if len(first):
        first[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return first


def _range_of(a: np.ndarray, b: np.ndarray, ranges: int) -> np.ndarray:
    """The range of a pair: of its mixed value, so that pairs with one frequent half are spread."""
    mixed = mix64(a * np.uint64(0x9E3779B97F4A7C15) + b)
    return ((mixed >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def _numbered(a: np.ndarray, b: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs by range: one place of each, whether there are more, the cuts between ranges, and each entry's number."""
    order = np.lexsort((b, a))
    first = _first_of(a[order], b[order])
    group = np.cumsum(first) - 1
    twice = np.bincount(group, minlength=1) > 1
    keys = order[first]
    which = _range_of(a[keys], b[keys], ranges)
    by = np.argsort(which, kind="stable")
    number = np.empty(len(by), np.int64)
    number[by] = np.arange(len(by))
    pair = np.empty(len(a), np.int64)
    pair[order] = number[group]
    return keys[by], twice[: len(keys)][by], np.searchsorted(which[by], np.arange(ranges + 1)), pair


def _ask(block: int, a: np.ndarray, b: np.ndarray, ranges: int, state: tuple[np.ndarray, np.ndarray] | None = None) -> list[dict]:
    """A block's distinct pairs, to their ranges (``place``), with a bit for those that it holds twice.

    ``state`` (open starts, positions) travels along, for rounds that cannot be told from the texts.
    """
    keys, twice, cut, pair = _numbered(a, b, ranges)
    out = []
    for r in np.flatnonzero(np.diff(cut)).tolist():
        i = slice(cut[r], cut[r + 1])
        out.append(_row("ask", block, r, a[keys[i]], b[keys[i]], np.packbits(twice[i])))
    if state is not None and len(a):
        out.append(_row("state", block, block % ranges, *(np.concatenate(_stretches(x)) for x in state), pair.astype("<u4"), cut.astype("<u4")))
    return out


def _ranked(group: pa.Table) -> pa.Table:
    """A range's pairs sorted and numbered; those that stand at one position only get no rank.

    A block is answered in the order of its own message: a bit for each pair that has a rank, and the ranks.
    """
    rows = group.to_pylist()
    asks = [r for r in rows if r["kind"] == "ask"]
    out = [r for r in rows if r["kind"] != "ask"]
    if not asks:
        return _table(out)
    sizes = [len(r["a"]) // 8 for r in asks]
    a = np.concatenate([_ints(r["a"], "<u8") for r in asks])
    b = np.concatenate([_ints(r["b"], f"<u{len(r['b']) // n}") for r, n in zip(asks, sizes)])
    twice = np.concatenate([np.unpackbits(_ints(r["c"], np.uint8), count=n) for r, n in zip(asks, sizes)])
    order = np.lexsort((b, a))
    key = np.cumsum(_first_of(a[order], b[order])) - 1
    often = np.bincount(key, 1 + twice[order]) > 1
    rank = np.zeros(len(a), np.uint64)
    rank[order] = np.where(often[key], (np.uint64(rows[0]["place"] + 1) << np.uint64(32)) + key.astype(np.uint64), np.uint64(0))
    for r, i, n in zip(asks, np.cumsum(sizes) - sizes, sizes):
        part = rank[i : i + n]
        if part.any():
            out.append(_row("rank", r["block"], r["place"], np.packbits(part > 0), part[part > 0]))
    return _table(out)


def _answers(rows: list[dict], cut: np.ndarray) -> np.ndarray:
    """The rank of each of a block's pairs, by number; 0 for unique ones."""
    rank = np.zeros(int(cut[-1]), np.uint64)
    for r in rows:
        if r["kind"] == "rank":
            i, j = int(cut[r["place"]]), int(cut[r["place"] + 1])
            rank[i:j][np.unpackbits(_ints(r["a"], np.uint8), count=j - i).astype(bool)] = _ints(r["b"], "<u8")
    return rank


def _needed(starts: np.ndarray, more: int) -> np.ndarray:
    """Ascending positions from each start to ``more`` behind it."""
    edges = np.zeros(int(starts[-1]) + more + 2, np.int32)
    edges[starts] = 1
    np.add.at(edges, starts + more + 1, -1)
    return np.flatnonzero(np.cumsum(edges) > 0)


def _doubled(starts: np.ndarray, positions: np.ndarray, rank: np.ndarray, length: int, longer: int, threshold: int):
    """Starts that stay open, the positions that they need at ``longer``, and the rank pairs there; from the ranks at ``length``."""
    # A start stays open if no position that its string needs has become unique.
    gone = np.concatenate([[0], np.cumsum(rank == 0)])
    at = np.searchsorted(positions, starts)
    starts = starts[gone[at + threshold - length + 1] == gone[at]]
    if not len(starts):
        return None
    needed = _needed(starts, threshold - longer)
    at = np.searchsorted(positions, needed)
    return starts, needed, rank[at], rank[at + longer - length]


def _next_messages(block: int, found, longer: int, threshold: int, ranges: int) -> pa.Table:
    if found is None:
        return _table([])
    starts, positions, a, b = found
    return _table(_ask(block, a, b, ranges, (starts, positions)) if longer < threshold else _last(block, a, b, positions, ranges))


def _round(length: int, longer: int, threshold: int, ranges: int) -> Callable[[pa.Table], pa.Table]:
    """The step of a block from its state and ranks at ``length`` to pairs at ``longer``."""

    def step(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        state = next((r for r in rows if r["kind"] == "state"), None)
        if state is None:
            return _table([])
        starts, positions = (_spread(*_ints(state[c]).astype(np.int64).reshape(2, -1)) for c in "ab")
        rank = _answers(rows, _ints(state["d"]))[_ints(state["c"])]
        return _next_messages(state["block"], _doubled(starts, positions, rank, length, longer, threshold), longer, threshold, ranges)

    return step


# The corpus ---------------------------------------------------------------------------------------


class Corpus:
    """Documents written in their order, in blocks; and the marks of what came before."""

    def __init__(self, docs: DataFrame, threshold: int, doc_id: str, text: str, block_bytes: int | None = None, range_bytes: int | None = None):
        self.columns, self.schema, self.threshold, self.text = docs.columns, docs.schema, threshold, text
        self.block, self.at = fresh_name("block", docs.columns), fresh_name("at", docs.columns)
        size = docs.agg(F.sum(F.octet_length(F.col(f"`{text}`")))).first()[0] or 0
        self.block_bytes = block_bytes or min(max(size >> 12, BLOCK_BYTES[0]), BLOCK_BYTES[1])
        self.ranges = max(1, math.ceil(size / (range_bytes or min(max(size >> 12, RANGE_BYTES[0]), RANGE_BYTES[1]))))
        blocks = max(1, math.ceil(size / self.block_bytes))
        spread = docs.sparkSession.sparkContext.defaultParallelism
        self.parts = min(blocks, max(3 * spread, blocks // 16))
        self.folders: list[str] = []
        self.table = self._keep(self._in_order(docs, doc_id), "blocks")
        self.texts = self.table.select(F.col(self.block).alias("block"), F.col(self.at).alias("at"), F.col(f"`{text}`").alias("text"))

    def _keep(self, df: DataFrame, tag: str) -> DataFrame:
        return materialize(df, tag, self.folders, "zstd")

    def _in_order(self, docs: DataFrame, doc_id: str) -> DataFrame:
        """Rows by doc_id (nulls first), equal ones by a hash of the text, with block and place in the block."""
        names = [fresh_name(n, docs.columns) for n in ("doc", "mark", "row", "part")]
        doc, mark, row, part = names
        own = [F.col(f"`{c}`") for c in self.columns]
        rows = docs.select(*own, F.col(f"`{doc_id}`").cast("long").alias(doc), F.xxhash64(f"`{self.text}`").alias(mark), F.monotonically_increasing_id().alias(row))
        order = [F.col(doc).asc_nulls_first(), F.col(mark), F.col(row)]  # the row tells only equal texts of equal ids apart
        rows = rows.repartitionByRange(self.parts, *order).sortWithinPartitions(*order)
        rows = rows.select(*own, F.spark_partition_id().alias(part))
        at, most, block_name, at_name = self.columns.index(self.text), self.block_bytes, self.block, self.at

        def place(batches):
            lean_worker()
            done, number, begun = 0, -1, 0
            for batch in batches:
                if not batch.num_rows:
                    continue
                _, offs = text_bytes(batch.column(at))
                before = done + offs[:-1]
                blocks = before // most
                new = np.flatnonzero(np.diff(blocks, prepend=number) != 0)
                start = np.full(len(blocks), begun)
                for i in new.tolist():
                    start[i:] = before[i]
                done, number, begun = done + int(offs[-1]), int(blocks[-1]), int(start[-1])
                where = (batch.column(batch.num_columns - 1)[0].as_py() << 32) + blocks
                columns = [*batch.columns[:-1], pa.array(where), pa.array(before - start)]
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], block_name, at_name])

        schema = docs.select(*own, F.lit(0).cast("long").alias(self.block), F.lit(0).cast("long").alias(self.at)).schema
        return rows.mapInArrow(place, schema)

    def marks(self) -> DataFrame:
        """(block, place, length) arrays of all string starts that came before."""
        threshold, ranges, lengths = self.threshold, self.ranges, doubling_lengths(self.threshold)

        def anchors(batches):
            lean_worker()
            for batch in batches:
                block, at = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                buf, offs = text_bytes(batch.column(2))
                cut = np.append(np.flatnonzero(_first_of(block)), len(block)) if len(block) else np.zeros(1, int)
                out = []
                for i, j in zip(cut[:-1].tolist(), cut[1:].tolist()):
                    out += _runs_of(int(block[i]), int(at[i]), buf[offs[i] : offs[j]], offs[i + 1 : j + 1] - offs[i], threshold, ranges)
                yield from _table(out).to_batches()

        runs_by_name = self.texts.mapInArrow(anchors, MESSAGE).groupBy("place")
        settled = self._keep(runs_by_name.applyInArrow(_settled, MESSAGE), "runs")

        base = lengths[0]

        def open_positions(left: pa.Table, right: pa.Table):
            """A block's number, open starts, the positions that they need, and the names there."""
            _, buf, _, _ = _block_rows(left, 1, 2)
            starts = np.sort(_marked(right.filter(pc.equal(right.column("kind"), "open"))))
            positions = _needed(starts, threshold - base)
            a, b = base_names(buf, positions, base)
            return left.column(0)[0].as_py(), starts, positions, a, (b >> np.uint64(32)).astype("<u4")

        def first_round(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows or not right.num_rows:
                return _table([])
            block, starts, positions, a, b = open_positions(left, right)
            return _table(_ask(block, a, b, ranges) if base < threshold else _last(block, a, b, positions, ranges))

        def second_round(left: pa.Table, right: pa.Table) -> pa.Table:
            rows = right.filter(pc.equal(right.column("kind"), "rank")).to_pylist()
            if not left.num_rows or not rows:
                return _table([])
            block, starts, positions, a, b = open_positions(left, right)
            _, _, cut, pair = _numbered(a, b, ranges)
            return _next_messages(block, _doubled(starts, positions, _answers(rows, cut)[pair], base, lengths[1], threshold), lengths[1], threshold, ranges)

        opened = settled.where("kind = 'open'")
        blocks = self.texts.groupBy("block")
        asked = blocks.cogroup(opened.groupBy("block")).applyInArrow(first_round, MESSAGE)
        for k, (length, longer) in enumerate(zip(lengths[:-1], lengths[1:])):
            ranked = self._keep(asked.groupBy("place").applyInArrow(_ranked, MESSAGE), f"rank{length}")
            if k == 0:  # names follow from the texts, so no state travels
                asked = blocks.cogroup(opened.unionByName(ranked).groupBy("block")).applyInArrow(second_round, MESSAGE)
            else:
                asked = ranked.groupBy("block").applyInArrow(_round(length, longer, threshold, ranges), MESSAGE)
        again = asked.groupBy("place").applyInArrow(_came_before, MESSAGE)
        found = self._keep(settled.where("kind = 'repeat'").unionByName(again).select("block", "a", "b"), "marks")
        for folder in self.folders[1:-1]:  # the rounds; the result still reads the blocks and the marks
            clear_path(self.table.sparkSession, folder)
        return found


def _runs_of(block: int, at: int, buf: np.ndarray, ends: np.ndarray, threshold: int, ranges: int) -> list[dict]:
    """Runs of a stretch of documents, each distinct anchor once, to the ranges of their names.

    Runs whose anchor stands in the stretch with other bytes around are open at once, so that only
    one message for each anchor leaves: its bytes, or (second content 0) that there are several.
    """
    place, length, names, content, second = runs(buf, ends, threshold)
    order = np.lexsort((second, content, names))  # stable: the earliest of equal runs comes first
    distinct = _first_of(names[order], content[order], second[order])
    head = np.flatnonzero(_first_of(names[order]))
    kinds = np.add.reduceat(distinct.astype(np.int64), head) if len(head) else np.zeros(0, np.int64)
    several = np.repeat(kinds, np.diff(np.append(head, len(order)))) > 1
    place = place + at
    again, opened = order[~distinct], order[distinct & several]
    sent = order[head]
    content, second = content.copy(), second | np.uint64(1)
    second[order[head[kinds > 1]]] = 0
    which = ((names[sent] >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
    by = np.argsort(which, kind="stable")
    cut = np.searchsorted(which[by], np.arange(ranges + 1))
    out = []
    for r in np.flatnonzero(np.diff(cut)).tolist():
        i = sent[by[cut[r] : cut[r + 1]]]
        out.append(_row("run", block, r, names[i], content[i], second[i], np.concatenate([place[i], length[i]]).astype("<u4")))
    for kind, i in (("repeat", again), ("open", opened)):
        if len(i):
            out.append(_row(kind, block, block % ranges, place[i].astype("<u4"), length[i].astype("<u4")))
    return out


def _settled(group: pa.Table) -> pa.Table:
    """A range's runs: repeats as a whole, open ones, or unique (gone)."""
    rows = group.to_pylist()
    out, sent = [r for r in rows if r["kind"] != "run"], [r for r in rows if r["kind"] == "run"]
    if not sent:
        return _table(out)
    names, content, second = (np.concatenate([_ints(r[c], "<u8") for r in sent]) for c in "abc")
    place, length = (np.concatenate(x) for x in zip(*(_ints(r["d"]).reshape(2, -1) for r in sent)))
    block = np.repeat([r["block"] for r in sent], [len(r["a"]) // 8 for r in sent])
    order = np.lexsort((place, block, second, content, names))
    names, content, second, block, place, length = (x[order] for x in (names, content, second, block, place, length))
    known = second != 0  # else its own block has opened it
    distinct = _first_of(names, content, second)
    head = np.flatnonzero(_first_of(names))
    size = np.diff(np.append(head, len(names)))
    kinds = np.add.reduceat(np.where(known, distinct, 2), head)
    opened = distinct & known & (np.repeat(kinds, size) > 1)
    for kind, hit in (("repeat", ~distinct & known), ("open", opened)):
        i = np.flatnonzero(hit)
        i = i[np.argsort(block[i], kind="stable")]
        for part in np.split(i, np.flatnonzero(np.diff(block[i])) + 1) if len(i) else []:
            out.append(_row(kind, int(block[part[0]]), 0, place[part].astype("<u4"), length[part].astype("<u4")))
    return _table(out)


def _last(block: int, a: np.ndarray, b: np.ndarray, places: np.ndarray, ranges: int) -> list[dict]:
    """The block's distinct pairs at the threshold with their first places, to their ranges; later places are repeats."""
    order = np.lexsort((b, a))  # stable, and places ascend
    first = _first_of(a[order], b[order])
    again, keys = np.sort(places[order[~first]]), order[first]
    which = _range_of(a[keys], b[keys], ranges)
    by = np.argsort(which, kind="stable")
    cut = np.searchsorted(which[by], np.arange(ranges + 1))
    out = []
    for r in np.flatnonzero(np.diff(cut)).tolist():
        i = keys[by[cut[r] : cut[r + 1]]]
        out.append(_row("ask", block, r, a[i], b[i], places[i].astype("<u4")))
    if len(again):
        out.append(_row("repeat", block, block % ranges, *_stretches(again)))
    return out


def _came_before(group: pa.Table) -> pa.Table:
    """Repeats among a range's pairs at the threshold: all but the one of the first block."""
    rows = group.to_pylist()
    out, asks = [r for r in rows if r["kind"] != "ask"], [r for r in rows if r["kind"] == "ask"]
    if asks:
        a, place = (np.concatenate([_ints(r[c], k) for r in asks]) for c, k in (("a", "<u8"), ("c", "<u4")))
        b = np.concatenate([_ints(r["b"], f"<u{8 * len(r['b']) // len(r['a'])}") for r in asks])
        block = np.repeat([r["block"] for r in asks], [len(r["c"]) // 4 for r in asks])
        order = np.lexsort((block, b, a))
        again = order[~_first_of(a[order], b[order])]
        again = again[np.lexsort((place[again], block[again]))]
        for part in np.split(again, np.flatnonzero(np.diff(block[again])) + 1) if len(again) else []:
            out.append(_row("repeat", int(block[part[0]]), 0, *_stretches(place[part].astype(np.int64))))
    return _table(out)


def _block_rows(table: pa.Table, at: int, text: int):
    """A block's rows in document order: their order, bytes, offsets and the texts."""
    order = pc.sort_indices(table.column(at).combine_chunks())
    body = table.column(text).combine_chunks().take(order)
    body = pa.concat_arrays(body.chunks) if isinstance(body, pa.ChunkedArray) and body.num_chunks > 1 else body.chunk(0) if isinstance(body, pa.ChunkedArray) else body
    buf, offs = text_bytes(body)
    return order, buf, offs, body


def _marked(marks: pa.Table) -> np.ndarray:
    """All marked starts of a block."""
    rows = marks.select(["a", "b"]).to_pylist()
    place, length = (np.concatenate([np.zeros(0, "<u4"), *(_ints(r[c]) for r in rows)]).astype(np.int64) for c in "ab")
    return _spread(place, length)


def _covered(places: np.ndarray, size: int, threshold: int) -> np.ndarray:
    """Which bytes a marked string covers."""
    steps = np.zeros(size + 1, np.int32)
    np.add.at(steps, places, 1)
    np.add.at(steps, np.minimum(places + threshold, size), -1)
    return np.cumsum(steps[:-1]) > 0


def repeated_bytes(docs: DataFrame, threshold: int = 100, doc_id: str = "doc_id", text: str = "text", block_bytes: int | None = None, range_bytes: int | None = None) -> DataFrame:
    """What a cut of all repeated ``threshold``-byte strings leaves: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A byte goes if a string of ``threshold`` bytes that covers it also starts earlier: in a
    document with a smaller doc_id (null is the smallest; equal ids go by a hash of their texts),
    or earlier in the same one.  Null and empty texts have no bytes; a text may be as long as its
    column allows.  One row for each input row: rows of equal id count as different documents, so
    a repeated row is cut whole.  An empty table gives no rows.  Other columns are not read.
    """
    corpus = Corpus(docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")), threshold, "doc_id", "text", block_bytes, range_bytes)
    names = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        lean_worker()
        if not left.num_rows:
            return pa.table({n: pa.array([], t) for n, t in names})
        order, buf, offs, _ = _block_rows(left, 2, 1)
        gone = _covered(_marked(right), len(buf), threshold)
        rows = []
        for a, b in zip(offs[:-1].tolist(), offs[1:].tolist()):
            g = gone[a:b]
            edge = int(g[:1].sum()) + int((g[1:] & ~g[:-1]).sum())
            rows.append((b - a, int(g.sum()), edge, hashlib.sha256(buf[a:b][~g].tobytes()).hexdigest()))
        cols = list(zip(*rows))
        return pa.table([left.column(0).combine_chunks().take(order), *(pa.array(c, t) for c, (_, t) in zip(cols, names[1:]))], names=[n for n, _ in names])

    rows = corpus.table.select("doc_id", "text", corpus.at, corpus.block)
    return rows.groupBy(corpus.block).cogroup(corpus.marks().groupBy("block")).applyInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, threshold: int = 100, doc_id: str = "doc_id", text: str = "text", drop_empty: bool = True) -> DataFrame:
    """The documents without their repeated strings, all columns kept; those with nothing left go.

    Cuts fall between characters: a character of which a byte stays, stays.  A null text, and a
    text that was empty before, stay as they are.  ``n_chars`` is recounted where it exists.  Ties,
    repeated rows, null ids and empty tables are as in ``repeated_bytes``; columns may have any name.
    """
    columns, schema = docs.columns, docs.schema
    corpus = Corpus(docs, threshold, doc_id, text)
    at, count = columns.index(text), columns.index("n_chars") if "n_chars" in columns else None
    width = len(columns)

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        lean_worker()
        left = left.combine_chunks()
        if not left.num_rows or not right.num_rows:
            return left.select(left.column_names[:width])
        order, buf, offs, _ = _block_rows(left, width, at)
        left = left.select(left.column_names[:width]).take(order)
        gone = _covered(_marked(right), len(buf), threshold)
        texts, sizes, empty = left.column(at).to_pylist(), left.column(count).to_pylist() if count is not None else None, []
        touched = np.add.reduceat(np.append(gone, False).astype(np.int64), offs[:-1]) * (np.diff(offs) > 0)
        for i in np.flatnonzero(touched).tolist():
            part, g = buf[offs[i] : offs[i + 1]], gone[offs[i] : offs[i + 1]]
            lead = np.flatnonzero((part & 0xC0) != 0x80)
            whole = np.minimum.reduceat(g, lead)  # a character goes if all its bytes go
            texts[i] = part[~np.repeat(whole, np.diff(np.append(lead, len(part))))].tobytes().decode("utf-8", "replace")
            if sizes is not None:
                sizes[i] = len(texts[i])
            if drop_empty and not texts[i].strip():
                empty.append(i)
        left = left.set_column(at, left.schema.field(at), pa.array(texts, left.schema.field(at).type))
        if sizes is not None:
            left = left.set_column(count, left.schema.field(count), pa.array(sizes, left.schema.field(count).type))
        stay = np.ones(left.num_rows, bool)
        stay[empty] = False
        return left.filter(pa.array(stay))

    rows = corpus.table.select(*[F.col(f"`{c}`") for c in columns], corpus.at, corpus.block)
    return rows.groupBy(corpus.block).cogroup(corpus.marks().groupBy("block")).applyInArrow(cut, schema)
