"""Benchmark decontamination with a generalised suffix automaton.

The automaton of all normalised test items is small and is broadcast; training tokens stream
through it.  For every token it gives the longest stretch of item words that ends there; where
that reaches the window, the covered words are hit, and the state tells which items hold it.

The items go into automata of at most ``BLOCK_WORDS`` words each.  A task keeps one of them
built at a time and runs its whole batch of documents through each in turn, so that a large set of
items costs time, in proportion to its blocks, not memory.  Items of more than ``MAX_ITEM_BYTES`` in all are broadcast slice by
slice: the documents stream through the blocks of each slice, only hits are written, and the
spans of all slices are merged by document.  Results are the same at every size.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, lean_worker, materialize, row_blocks, text_bytes, word_spans

WINDOW = 10
BLOCK_WORDS = 200_000
MAX_ITEM_BYTES = 64 << 20


def normal_words(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text: A-Z lower-cased; all but ASCII letters, digits and bytes beyond ASCII separates."""
    return text.lower().translate(bytes(b if ALNUM[b] else 32 for b in range(256))).split()


class SuffixAutomaton:
    """The generalised suffix automaton of word sequences, with the items that each state occurs in.

    ``window`` words make a window; an item of fewer words is one window by itself.
    """

    def __init__(self, items: list[tuple[int, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        #: Items at each state: all those with an occurrence of its words; and those that are just these words.
        own: list[set[int]] = [set()]
        self.whole: list[dict[int, set[int]]] = [{}]
        for number, (_, words) in enumerate(items):
            last = 0
            for word in words:
                last = self._extend(last, word, own)
                own[last].add(number)
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            if self.link[state] > 0:
                own[self.link[state]] |= own[state]
        self.items = own
        for number, (_, words) in enumerate(items):
            if 0 < len(words) < window:
                state = 0
                for word in words:
                    state = self.next[state][word]
                self.whole[state].setdefault(len(words), set()).add(number)
        self.shortest = min([window, *(len(w) for _, w in items if w)])
        self.has_short = self.shortest < window
        self.words = {w for _, words in items for w in words}
        self.ids = [i for i, _ in items]

    def _new(self, length: int, link: int, after: dict, own: list[set[int]], items: set[int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(after)
        self.whole.append({})
        own.append(items)
        return len(self.length) - 1

    def _extend(self, last: int, word: bytes, own: list[set[int]]) -> int:
        nxt, link, length = self.next, self.link, self.length
        q = nxt[last].get(word)
        if q is not None and length[q] == length[last] + 1:
            return q
        fresh = -1
        if q is None:
            fresh = self._new(length[last] + 1, 0, {}, own, set())
            p = last
            while p != -1 and word not in nxt[p]:
                nxt[p][word] = fresh
                p = link[p]
            if p == -1:
                return fresh
            q = nxt[p][word]
            if length[q] == length[p] + 1:
                link[fresh] = q
                return fresh
        else:
            p = last
        copy = self._new(length[p] + 1, link[q], dict(nxt[q]), own, set())
        while p != -1 and nxt[p].get(word) == q:
            nxt[p][word] = copy
            p = link[p]
        link[q] = copy
        if fresh < 0:
            return copy
        link[fresh] = copy
        return fresh

    def scan(self, words: list[bytes], base: int, spans: list[tuple[int, int]], found: set[int]) -> None:
        """Stream ``words`` (numbered from ``base``); add hit word spans and item numbers."""
        nxt, link, length, window = self.next, self.link, self.length, self.window
        state = matched = 0
        seen = set()
        for at, word in enumerate(words, base):
            while state and word not in nxt[state]:
                state = link[state]
                matched = length[state]
            if word in nxt[state]:
                state = nxt[state][word]
                matched += 1
            if matched >= window:
                spans.append((at + 1 - window, at + 1))
                top = state
                while length[link[top]] >= window:
                    top = link[top]
                if top not in seen:
                    seen.add(top)
                    found |= self.items[top]
            if self.has_short:
                top = state
                while top > 0:
                    for n, items in self.whole[top].items():
                        if n <= (matched if top == state else length[top]):
                            spans.append((at + 1 - n, at + 1))
                            found |= items
                    top = link[top]


class _Blocks:
    """Automata of the item blocks; one is kept built."""

    def __init__(self, blocks: list[list[tuple[int, list[bytes]]]], window: int):
        self.blocks, self.window, self.at, self.built = blocks, window, -1, None

    def __iter__(self) -> Iterator[SuffixAutomaton]:
        for i in range(len(self.blocks)):
            if self.at != i:
                self.at, self.built = i, None
                self.built = SuffixAutomaton(self.blocks[i], self.window)
            yield self.built


def item_blocks(rows: list[tuple[int, str | None]], block_words: int | None = None) -> list[list[tuple[int, list[bytes]]]]:
    """Items with words in blocks of at most ``block_words`` (``BLOCK_WORDS``) words; a longer item is a block by itself."""
    most = BLOCK_WORDS if block_words is None else block_words
    blocks, words = [[]], 0
    for item, text in rows:
        w = normal_words((text or "").encode())
        if not w:
            continue
        if words + len(w) > most and blocks[-1]:
            blocks.append([])
            words = 0
        blocks[-1].append((item, w))
        words += len(w)
    return [b for b in blocks if b]


def _hits(batch_text: pa.Array, automata: _Blocks):
    """For each row: words, merged hit spans (word numbers in the row), byte spans of the words, items."""
    buf, offs = text_bytes(batch_text)
    low = np.arange(256, dtype=np.uint8)
    low[65:91] += 32
    spans: dict[int, list] = {}
    items: dict[int, set] = {}
    slices = list(row_blocks(offs))
    for auto in automata:  # each is built once for the batch
        known = _word_hashes(auto)
        for r0, r1 in slices:
            part = buf[offs[r0] : offs[r1]]
            starts, ends, rows, hashes = word_spans(part, offs[r0 : r1 + 1] - offs[r0], ALNUM)
            if not len(known) or not len(hashes):
                continue
            first = np.searchsorted(rows, np.arange(r1 - r0 + 1))
            inside = known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes
            # Only runs of item words that are long enough for a window pass through the automaton.
            edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]])))
            cuts = np.unique(np.concatenate([edge, first[(first > 0) & (first < len(inside))]]))
            text = None
            for a, b in zip(cuts[:-1], cuts[1:]):
                if b - a >= auto.shortest and inside[a]:
                    text = low[part].tobytes() if text is None else text
                    row = int(rows[a])
                    words = [text[s:e] for s, e in zip(starts[a:b].tolist(), ends[a:b].tolist())]
                    got: set[int] = set()
                    auto.scan(words, int(a - first[row]), spans.setdefault(r0 + row, []), got)
                    items.setdefault(r0 + row, set()).update(auto.ids[i] for i in got)
    out = []
    for r0, r1 in slices:
        local = offs[r0 : r1 + 1] - offs[r0]
        starts, ends, rows, _ = word_spans(buf[offs[r0] : offs[r1]], local, ALNUM)
        first = np.searchsorted(rows, np.arange(r1 - r0 + 1))
        for row in range(r1 - r0):
            merged: list[list[int]] = []
            for a, b in sorted(spans.get(r0 + row, ())):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            base = int(first[row])
            out.append((int(first[row + 1]) - base, merged, [(int(starts[base + a]) - int(local[row]), int(ends[base + b - 1]) - int(local[row])) for a, b in merged], items.get(r0 + row, set())))
    return out


def _word_hashes(auto: SuffixAutomaton) -> np.ndarray:
    if not hasattr(auto, "hashes"):
        blob = b" ".join(sorted(auto.words))
        buf = np.frombuffer(blob, np.uint8)
        auto.hashes = np.unique(word_spans(buf, np.array([0, len(buf)]), ALNUM)[3])
    return auto.hashes


RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, item_ids array<string>, spans array<struct<start: int, stop: int>>"


def items_digest(items: set) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


def item_slices(items: DataFrame, item_id: str = "item_id", text: str = "text", max_bytes: int = MAX_ITEM_BYTES) -> Iterator[list[tuple[int, str | None]]]:
    """The items in slices: all in one, or by hash in slices of about half of ``max_bytes``."""
    size, count = items.agg(F.sum(F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 32), F.count(F.lit(1))).first()
    slices = 1 if (size or 0) <= max_bytes else min(-(-2 * size // max_bytes), count)
    which = F.pmod(F.xxhash64(item_id, text), F.lit(slices))
    for k in range(slices):
        part = items.where(which == k) if slices > 1 else items
        yield [(r[0], r[1]) for r in part.select(item_id, text).orderBy(item_id, text).collect()]
        if slices == 1:
            return


#: Hit spans in words (a, b) and bytes (start, stop) of a document.
FOUND = "array<struct<a: long, b: long, start: long, stop: long>>"
_FOUND_TYPES = pa.schema([("__place", pa.int64()), ("__spans", pa.list_(pa.struct([(n, pa.int64()) for n in ("a", "b", "start", "stop")]))), ("__items", pa.list_(pa.string()))])


def _merged(found: list[dict]) -> tuple[list[list[int]], list[tuple[int, int]]]:
    """Hit spans of several slices as one: in words and in bytes."""
    words: list[list[int]] = []
    places: list[list[int]] = []
    for x in sorted(found, key=lambda x: (x["a"], x["b"])):
        if words and x["a"] <= words[-1][1]:
            if x["b"] > words[-1][1]:
                words[-1][1], places[-1][1] = x["b"], x["stop"]
        else:
            words.append([x["a"], x["b"]])
            places.append([x["start"], x["stop"]])
    return words, [(a, b) for a, b in places]


def _finder(docs: DataFrame, items: DataFrame, window: int, text: str, max_bytes: int):
    """``docs`` and a function that makes, inside a task, the function from batches to what ``_hits`` gives.

    Where the items take several slices, two columns with their hits follow those of ``docs``.
    """
    context, at = docs.sparkSession.sparkContext, docs.columns.index(text)
    slices = item_slices(items, text="text", max_bytes=max_bytes)
    rows, second = next(slices), next(slices, None)
    if second is None:
        shared = context.broadcast(item_blocks(rows))

        def begin():
            automata = _Blocks(shared.value, window)
            return lambda batch: _hits(batch.column(at), automata)

        return docs, begin

    columns = [F.col(f"`{c}`") for c in docs.columns]
    numbered = materialize(docs.select(*columns, F.monotonically_increasing_id().alias("__place")), "numbered")
    texts = numbered.select("__place", F.col(f"`{text}`"))

    def hits_of(shared):
        def work(batches):
            lean_worker()
            automata = _Blocks(shared.value, window)
            for batch in batches:
                found = _hits(batch.column(1), automata)
                rows = [
                    {"__place": place, "__spans": [{"a": a, "b": b, "start": s, "stop": e} for (a, b), (s, e) in zip(m, spans)], "__items": sorted(map(str, ids))}
                    for place, (_, m, spans, ids) in zip(batch.column(0).to_pylist(), found)
                    if m
                ]
                yield pa.RecordBatch.from_pylist(rows, schema=_FOUND_TYPES)

        return work

    parts = []
    for part in itertools.chain([rows, second], slices):
        if blocks := item_blocks(part):
            shared = context.broadcast(blocks)
            parts.append(materialize(texts.mapInArrow(hits_of(shared), f"__place long, __spans {FOUND}, __items array<string>"), "hits"))
            shared.destroy()
    met = functools.reduce(DataFrame.unionByName, parts) if parts else None
    none = [F.lit(None).cast(FOUND).alias("__spans"), F.lit(None).cast("array<string>").alias("__items")]
    if met is None:
        joined = numbered.select(*columns, *none)
    else:
        met = met.groupBy("__place").agg(F.flatten(F.collect_list("__spans")).alias("__spans"), F.array_distinct(F.flatten(F.collect_list("__items"))).alias("__items"))
        joined = numbered.join(met, "__place", "left").select(*columns, "__spans", "__items")

    def begin_merging():
        def found(batch):
            spans, ids = (batch.column(batch.num_columns - k).to_pylist() for k in (2, 1))
            return [(n, *_merged(s or []), set(i or [])) for (n, *_), s, i in zip(_hits(batch.column(at), ()), spans, ids)]

        return found

    return joined, begin_merging


def find_contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text", max_item_bytes: int = MAX_ITEM_BYTES) -> DataFrame:
    """Hit words of each document against the windows of the items.

    Columns: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, item_ids (sorted as
    strings) and spans (byte ranges of the hit stretches).  Null and empty texts have no words.
    Items without words match nothing; repeated items count by their id.  Every input row gives
    one row, repeated doc_ids and null ones too.  Columns other than the two named are not read.
    A text of any length is streamed through the automaton whole.
    """
    docs, begin = _finder(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), items, window, "text", max_item_bytes)

    def work(batches):
        lean_worker()
        find = begin()
        for batch in batches:
            found = find(batch)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([n for n, *_ in found], pa.int64()),
                    pa.array([sum(b - a for a, b in m) for _, m, _, _ in found], pa.int64()),
                    pa.array([len(i) for *_, i in found], pa.int64()),
                    pa.array([items_digest(i) for *_, i in found], pa.string()),
                    pa.array([bool(m) for _, m, _, _ in found], pa.bool_()),
                    pa.array([sorted(map(str, i)) for *_, i in found], pa.list_(pa.string())),
                    pa.array([[{"start": a, "stop": b} for a, b in s] for _, _, s, _ in found], pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))),
                ],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "item_ids", "spans"],
            )

    return docs.mapInArrow(work, RESULT)


def remove_contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_words: int = 200, max_share: float = 0.5, text: str = "text", drop: bool = True, max_item_bytes: int = MAX_ITEM_BYTES) -> DataFrame:
    """Documents without their hit spans; those with over ``max_words`` hit words or a hit share over ``max_share`` go.

    All columns stay, with ``text`` cut (and ``n_chars`` recounted where it exists).  Null texts
    stay as they are.  Words that a cut separated are never joined: one space takes its place.
    Repeated rows and null ids are rows like others; no items change nothing; an empty table gives
    no rows; texts may be of any length.
    """
    names, schema = docs.columns, docs.schema
    at = names.index(text)
    docs, begin = _finder(docs, items, window, text, max_item_bytes)

    def work(batches):
        lean_worker()
        find = begin()
        for batch in batches:
            found = find(batch)
            batch = pa.RecordBatch.from_arrays(batch.columns[: len(names)], schema=pa.schema(list(batch.schema)[: len(names)]))
            texts = batch.column(at)
            keep = [i for i, (n, m, _, _) in enumerate(found) if not (drop and (sum(b - a for a, b in m) > max_words or sum(b - a for a, b in m) > max_share * n))]
            changed = {}
            for i in keep:
                if found[i][2]:
                    raw, out, last = texts[i].as_py().encode(), [], 0
                    for a, b in found[i][2]:
                        out.append(raw[last:a])
                        last = b
                    out.append(raw[last:])
                    changed[i] = b" ".join(x.strip() for x in out if x.strip()).decode("utf-8", "replace")
            part = batch.take(pa.array(keep, pa.int64()))
            if changed:
                cols = part.columns
                new = [changed.get(i, x) for i, x in zip(keep, part.column(at).to_pylist())]
                cols[at] = pa.array(new, part.schema.field(at).type)
                if "n_chars" in names:
                    k = names.index("n_chars")
                    cols[k] = pa.array([len(changed[i]) if i in changed else x for i, x in zip(keep, cols[k].to_pylist())], part.schema.field(k).type)
                part = pa.RecordBatch.from_arrays(cols, schema=part.schema)
            yield part

    return docs.mapInArrow(work, schema)
