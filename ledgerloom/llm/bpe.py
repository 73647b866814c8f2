"""Byte-level BPE with DuckDB: recursive queries contract the pairs of every word.

Each task splits its texts with the tokenizer's pattern and hands the distinct words it has not
met yet to DuckDB.  There a word unfolds into rows of (word, position, token); a recursive query joins each
pair of neighbours to the merge table, contracts the word's leftmost pair of minimum rank and
goes on until no pair of any word is in the table.  An ordered aggregate gathers ids, and another
one decodes them.  Words and their ids stay in a bounded cache, so a word is contracted once for
each worker, not once for each time it occurs.

A word may be as long as its text.  Contraction costs the square of a word's length, so a word of
more than ``SHORT`` bytes is cut into pieces, and the ids of neighbouring pieces are joined by
contracting what lies around the cut once more.  That is exact for any merge table: ids are those
of their text if and only if each two neighbours are the ids of their own joined bytes, since
contraction inside a stretch that no merge leaves goes the same way with or without its surroundings.
"""

from __future__ import annotations

import base64
import hashlib
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import caches, lean_worker

MOST_CACHED = 800_000
WORDS_AT_ONCE = 50_000
BYTES_AT_ONCE = 1 << 21
#: Words up to so many bytes are contracted whole; longer ones in pieces of so many characters.
SHORT = 256
PIECE = 64
#: Ids around a cut that are contracted again at first, on either side; four times as many after each miss.
REACH = 8
#: Ids that one query decodes, and characters of a text from which its words are encoded in runs of so many.
IDS_AT_ONCE = 200_000
LONG = 1 << 22
WORDS_IN_RUN = 200_000
MOST_FITTING = 200_000
NO_PAIR = np.iinfo(np.int64).max

#: Contract all words of the table ``words`` (number, tokens); a key keeps only a word's last state.
CONTRACT = """
WITH RECURSIVE steps(number, tokens) USING KEY (number) AS (
  SELECT number, tokens FROM words
  UNION ALL
  SELECT number, tokens[: best % 1048576 - 1] || [best // 1048576] || tokens[best % 1048576 + 2 :]
  FROM (
    SELECT p.number, any_value(p.tokens) AS tokens, min(m.merged::BIGINT * 1048576 + p.place) AS best
    FROM (SELECT number, tokens, unnest(generate_series(1, len(tokens) - 1)) AS place FROM steps WHERE len(tokens) > 1) p
    JOIN merges m ON m.first = p.tokens[p.place] AND m.second = p.tokens[p.place + 1]
    GROUP BY p.number))
SELECT number, tokens AS ids FROM steps ORDER BY number
"""


def merge_table(ranks: dict[bytes, int]) -> list[tuple[int, int, int]]:
    """Every way to cut a token into two tokens: (first, second, merged)."""
    out = []
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            a, b = ranks.get(token[:i]), ranks.get(token[i:])
            if a is not None and b is not None:
                out.append((a, b, rank))
    return out


class DuckBpe:
    """An encoder and decoder that keeps its tables in an in-memory DuckDB."""

    def __init__(self, path: str, pattern: str, cached: int = MOST_CACHED):
        import duckdb
        import regex

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        cut = regex.compile(pattern)
        self.split, self.each = cut.findall, cut.finditer
        self.most, self.cache = cached, dict[str, bytes]()
        self.decimals = list(map(str, range(max(self.ranks.values()) + 1)))
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.bytes_of = {i: t for t, i in self.ranks.items()}
        self.fitting: dict[tuple[int, int], bool] = {}
        pairs = merge_table(self.ranks)
        first, second, merged = (np.array(x, np.int64) for x in zip(*pairs))
        order = np.argsort(first << 32 | second)
        self.pair_keys, self.pair_merged = (first << 32 | second)[order], merged[order]
        first, second, merged = (pa.array(x, pa.int32()) for x in zip(*pairs))
        tables = {
            "merges": pa.table({"first": first, "second": second, "merged": merged}),
            "vocabulary": pa.table({"id": pa.array(list(self.ranks.values()), pa.int32()), "hex": [t.hex() for t in self.ranks]}),
        }
        for name, table in tables.items():
            self.db.register("given", table)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.db.unregister("given")

    def contract(self, words: list[str]) -> list[bytes]:
        """Token ids of each word, as the bytes of 32-bit integers."""
        raw = [w.encode() for w in words]
        long = [i for i, w in enumerate(raw) if len(w) > SHORT]
        if not long:
            return self._short(raw)
        short = iter(self._short([w for w in raw if len(w) <= SHORT]))
        joined = iter(self._long([words[i] for i in long]))
        return [next(joined if len(w) > SHORT else short) for w in raw]

    def _short(self, words: list[bytes]) -> list[bytes]:
        out: list[bytes] = []
        ends = np.concatenate([[0], np.cumsum([len(w) for w in words], dtype=np.int64)])
        i = 0
        while i < len(words):
            j = min(i + WORDS_AT_ONCE, max(i + 1, int(np.searchsorted(ends, ends[i] + BYTES_AT_ONCE, "right")) - 1), len(words))
            part = words[i:j]
            offs = pa.array(ends[i : j + 1] - ends[i], pa.int32())
            tokens = pa.ListArray.from_arrays(offs, pa.array(self.byte_ids[np.frombuffer(b"".join(part), np.uint8)]))
            self.db.register("words", pa.table({"number": pa.array(range(len(part)), pa.int64()), "tokens": tokens}))
            lists = self.db.sql(CONTRACT).to_arrow_table().column("ids").combine_chunks()
            self.db.unregister("words")
            flat, cuts = lists.values.to_numpy().astype(np.int32).tobytes(), (lists.offsets.to_numpy() * 4).tolist()
            out += [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
            i = j
        return out

    def _long(self, words: list[str]) -> list[bytes]:
        """Words in pieces, neighbours joined in rounds until each word is one."""
        cut = [[w[i : i + PIECE].encode() for i in range(0, len(w), PIECE)] for w in words]
        met = list(set().union(*cut))
        ids = {w: np.frombuffer(x, np.int32) for w, x in zip(met, self._short(met))}
        parts = [[ids[x] for x in pieces] for pieces in cut]
        while max(map(len, parts)) > 1:
            joined = iter(self._join([(p[i], p[i + 1]) for p in parts for i in range(0, len(p) - 1, 2)]))
            parts = [[next(joined) if i + 1 < len(p) else p[i] for i in range(0, len(p), 2)] for p in parts]
        return [p[0].tobytes() for p in parts]

    def _join(self, pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
        """The ids of each two neighbours' joined text."""
        out: list = [None] * len(pairs)
        left, reach = list(range(len(pairs))), REACH
        while left:
            around = [b"".join(map(self.bytes_of.__getitem__, [*pairs[k][0][-reach:].tolist(), *pairs[k][1][:reach].tolist()])) for k in left]
            distinct = list(set(around))
            ids = dict(zip(distinct, self._exact(distinct)))
            edges = {}
            for k, text in zip(left, around):
                (a, b), middle = pairs[k], ids[text]
                edges[k] = []
                if len(a) > reach and a[-reach] != middle[0]:
                    edges[k].append((int(a[-reach - 1]), int(middle[0])))
                if len(b) > reach and b[reach - 1] != middle[-1]:
                    edges[k].append((int(middle[-1]), int(b[reach])))
            self._learn({e for es in edges.values() for e in es})
            missed = []
            for k, text in zip(left, around):
                if all(self.fitting[e] for e in edges[k]):
                    a, b = pairs[k]
                    out[k] = np.concatenate([a[:-reach], ids[text], b[reach:]])
                else:
                    missed.append(k)
            left, reach = missed, reach * 4
        return out

    def _learn(self, edges: set[tuple[int, int]]) -> None:
        """Whether two tokens are the ids of their joined bytes."""
        if len(self.fitting) > MOST_FITTING:
            self.fitting = {}
        fresh = list(edges.difference(self.fitting))
        got = self._exact([self.bytes_of[a] + self.bytes_of[b] for a, b in fresh])
        self.fitting.update((e, e == tuple(x.tolist())) for e, x in zip(fresh, got))

    def _exact(self, words: list[bytes]) -> list[np.ndarray]:
        short = iter(self._short([w for w in words if len(w) <= SHORT]))
        return [np.frombuffer(next(short), np.int32) if len(w) <= SHORT else self._wide(w) for w in words]

    def _wide(self, word: bytes) -> np.ndarray:
        """The ids of a stretch whose pieces never fall into step, such as a long period: few ranks, often.

        Pairs of the minimum rank that do not overlap are contracted at once, from the left up to
        the first one whose new token makes a pair of a lower rank.
        """
        ids = self.byte_ids[np.frombuffer(word, np.uint8)]
        while len(ids) > 1:
            rank = self._pair_ranks(ids[:-1], ids[1:])
            least = rank.min()
            if least == NO_PAIR:
                break
            hit = np.flatnonzero(rank == least)
            count = np.arange(len(hit))
            start = np.maximum.accumulate(np.where(np.diff(hit, prepend=-2) != 1, count, 0))
            hit = hit[(count - start) % 2 == 0]
            before = np.where(np.diff(hit, prepend=-3) == 2, least, ids[hit - 1])
            lower = (hit > 0) & (self._pair_ranks(before, np.full(len(hit), least)) < least)
            lower |= (hit + 2 < len(ids)) & (self._pair_ranks(np.full(len(hit), least), ids[np.minimum(hit + 2, len(ids) - 1)]) < least)
            if lower.any():
                hit = hit[: int(np.argmax(lower)) + 1]
            ids[hit] = least
            ids = np.delete(ids, hit + 1)
        return ids

    def _pair_ranks(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        key = (first.astype(np.int64) << 32) | second
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_merged[at], NO_PAIR)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; the words of a long one in runs, so that they are never all in memory."""
        if len(texts) == 1 and len(texts[0]) > LONG:
            words = (m.group() for m in self.each(texts[0]))
            return [np.concatenate([self._encode([run])[0] for run in iter(lambda: list(islice(words, WORDS_IN_RUN)), [])])]
        return self._encode([self.split(t) for t in texts])

    def _encode(self, cut: list[list[str]]) -> list[np.ndarray]:
        if len(self.cache) > self.most:
            self.cache = {}
        fresh = list(set().union(*cut).difference(self.cache))
        self.cache.update(zip(fresh, self.contract(fresh)))
        ids = self.cache.__getitem__
        out = [np.frombuffer(b"".join(map(ids, words)), np.int32) for words in cut]
        for word in fresh:  # the cache is bounded by words, so it keeps no long ones
            if len(word) > SHORT:
                del self.cache[word]
        return out

    def digest(self, ids: np.ndarray) -> str:
        """The SHA-256 of the decimal ids, joined by spaces."""
        found, joint = hashlib.sha256(), ""
        for i in range(0, len(ids), IDS_AT_ONCE):
            found.update((joint + " ".join(map(self.decimals.__getitem__, ids[i : i + IDS_AT_ONCE].tolist()))).encode())
            joint = " "
        return found.hexdigest()

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """The bytes of each id sequence, gathered by an ordered aggregate over ``IDS_AT_ONCE`` ids at a time."""
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        row = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
        out: list[list[str]] = [[] for _ in ids]
        for i in range(0, len(flat), IDS_AT_ONCE):
            part = slice(i, i + IDS_AT_ONCE)
            self.db.register("tokens", pa.table({"number": row[part], "place": np.arange(len(flat[part])), "id": flat[part]}))
            for number, text in self.db.execute("SELECT t.number, string_agg(v.hex, '' ORDER BY t.place) AS hex FROM tokens t JOIN vocabulary v ON v.id = t.id GROUP BY t.number").fetchall():
                out[number].append(text)
            self.db.unregister("tokens")
        return [b"".join(map(bytes.fromhex, x)) for x in out]


_encoders: dict[tuple, DuckBpe] = caches.setdefault("bpe", {})


def _encoder(*key) -> DuckBpe:
    if key not in _encoders:
        _encoders[key] = DuckBpe(*key)
    return _encoders[key]


def text_pieces(texts: list[str], most: int = 1 << 22):
    """Runs of texts (from, to) of about ``most`` characters."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= most):
            size += len(texts[j])
            j += 1
        yield i, j
        i = j


def encode_documents(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False, cached: int = MOST_CACHED, piece: int = 1 << 22) -> DataFrame:
    """Encode and decode every text: doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids).

    Null texts count as empty and have no tokens.  One row for each input row, repeated and null
    doc_ids included; other columns are not read.  ``path`` must exist on every executor.
    Texts may have any length: the words of a long one are encoded, and its ids decoded, in runs.
    ``cached`` words stay in a worker and ``piece`` characters are worked on at a time: less of
    either takes less memory and more time.
    """

    def work(batches):
        lean_worker("bpe")
        bpe = _encoder(path, pattern, cached)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for a, b in text_pieces(texts, piece):
                ids = bpe.encode(texts[a:b])
                back = bpe.decode(ids)
                cols = [
                    batch.column(0).slice(a, b - a),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([bpe.digest(x) for x in ids]),
                    pa.array([hashlib.sha256(x).hexdigest() for x in back]),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    cols.append(pa.array(ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(work, schema)
