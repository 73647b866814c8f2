"""Token counts from the distinct pre-tokens of a corpus; no ids of a text are made.

A SentencePiece vocabulary with byte fallback joins neighbouring pieces only where their joint text
is a piece.  So a text may be cut wherever no piece holds what lies on both sides, and the tokens of
its parts are those of the whole.  Here texts are cut before white space (no piece has white space
behind another character) and around characters that occur in no piece of several characters.

Each task gathers blocks of documents: the distinct pre-tokens of the block, and for each document
how often it holds which of them.  The pre-tokens of all blocks are shuffled by their text and
sorted, so that each distinct one is counted once by the library; the counts go back to their blocks
and are summed over the frequencies of each document.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean_worker, materialize

SPACE = "▁"
#: Characters and distinct pre-tokens of a block, characters that are cut at a time, pre-tokens that are answered at a time.
BLOCK_CHARS = 16 << 20
BLOCK_WORDS = 400_000
CUT_CHARS = 1 << 20
ANSWERS = 200_000


class PieceModel:
    """How a vocabulary cuts texts into pre-tokens, and how many tokens each of those has."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        rules = model.normalizer_spec
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces:
            raise ValueError("texts are counted as they are written: a vocabulary that rewrites them is not supported")
        kind = model.trainer_spec
        if kind.model_type != kind.BPE or any(p.type == p.USER_DEFINED for p in model.pieces):
            raise ValueError("only merges of neighbouring pieces may be cut: other kinds of vocabulary are not supported")
        pieces = [p.piece for p in model.pieces if p.type == p.NORMAL and len(p.piece) > 1]
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("a piece with white space behind another character spans pre-tokens")
        joined = re.escape("".join(sorted(set("".join(pieces)) - {SPACE})))
        self.find = re.compile(f" +[{joined}]*|[{joined}]+|[^{joined} ]" if joined else " +|[^ ]").findall
        self.prefix = " " if rules.add_dummy_prefix else ""
        rules.add_dummy_prefix = False
        self.proto = model.SerializeToString()

    def parts(self, text: str) -> Iterator[list[str]]:
        """The pre-tokens of a text, some at a time."""
        if not text:
            return
        text = self.prefix + (text.replace(SPACE, " ") if SPACE in text else text)
        a = 0
        while a < len(text):
            b = a + CUT_CHARS
            while b < len(text):  # back to the last white space, and to the first one of its stretch
                cut = text.rfind(" ", a + 1, b)
                while cut > a and text[cut - 1] == " ":
                    cut -= 1
                if cut > a:
                    b = cut
                    break
                b += CUT_CHARS
            yield self.find(text[a:b] if a or b < len(text) else text)
            a = b

    def counter(self):
        """A function that gives the numbers of tokens of pre-tokens."""
        from sentencepiece import SentencePieceProcessor

        library = SentencePieceProcessor(model_proto=self.proto)
        return lambda words: list(map(len, library.encode(words, num_threads=1)))


class _Numbers(dict):
    """Numbers words as they come."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def _planes(values: np.ndarray) -> bytes:
    """Numbers below 2**32 byte plane by byte plane: the higher ones are mostly zero and leave little when packed."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


BLOCKS = "block long, ids array<long>, bytes array<long>, sizes array<int>, places binary, times binary, words array<string>"


def document_blocks(docs: DataFrame, model: PieceModel) -> DataFrame:
    """Blocks of documents: their ids, text sizes and numbers of distinct pre-tokens; which ones and how often, end to end; the pre-tokens."""

    def work(batches):
        lean_worker("tokencounts")
        task, blocks = TaskContext.get().partitionId(), 0
        numbers, rows, chars = _Numbers(), [], 0

        def block():
            ids, sizes, places, times = zip(*rows)
            cells = [[(task << 32) + blocks], [[i for i, _ in ids]], [[n for _, n in ids]], [sizes], [b"".join(places)], [b"".join(times)], [list(numbers)]]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.list_(pa.string())]
            cells[4:6] = ([_planes(np.frombuffer(x[0], "<u4"))] for x in cells[4:6])
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds)], names=[x.split()[0] for x in BLOCKS.split(", ")])

        for batch in batches:
            for doc_id, size, text in zip(*(c.to_pylist() for c in batch.columns)):
                found = Counter()
                for part in model.parts(text or ""):
                    found.update(part)
                place = np.fromiter(map(numbers.__getitem__, found), np.int64, len(found))
                often = np.fromiter(found.values(), np.int64, len(found))
                order = np.argsort(place)
                rows.append(((doc_id, size), len(found), np.diff(place[order], prepend=0).astype("<u4").tobytes(), often[order].astype("<u4").tobytes()))
                chars += len(text or "")
                if chars >= BLOCK_CHARS or len(numbers) >= BLOCK_WORDS:
                    yield block()
                    numbers, rows, chars, blocks = _Numbers(), [], 0, blocks + 1
        if rows:
            yield block()

    return docs.mapInArrow(work, BLOCKS)


def word_counts(words: DataFrame, model: PieceModel) -> DataFrame:
    """The number of tokens of each word of each block: block, places, counts.

    ``words`` has (block, place, word).  Equal words meet in one task, next to each other, and are
    counted once.  Answers for the same block leave together.
    """

    def work(batches):
        lean_worker("tokencounts")
        count = model.counter()
        last, n = None, 0
        held: list = [[], [], []]

        def answer():
            block, place, tokens = (np.concatenate(x) for x in held)
            order = np.argsort(block, kind="stable")
            block = block[order]
            cuts = np.flatnonzero(np.diff(block, prepend=block[0] - 1))
            offs = pa.array(np.append(cuts, len(block)), pa.int32())
            lists = [pa.ListArray.from_arrays(offs, pa.array(x[order], pa.int32())) for x in (place, tokens)]
            return pa.RecordBatch.from_arrays([pa.array(block[cuts]), *lists], names=["block", "places", "counts"])

        for batch in batches:
            texts = batch.column(2).to_pylist()
            fresh = np.ones(len(texts), bool)
            fresh[1:] = [a != b for a, b in zip(texts, texts[1:])]
            fresh[0] = texts[0] != last
            new = [texts[i] for i in np.flatnonzero(fresh).tolist()]
            tokens = np.array([n, *count(new)], np.int64)[np.cumsum(fresh)]
            last, n = texts[-1], int(tokens[-1])
            for x, y in zip(held, (batch.column(0).to_numpy(), batch.column(1).to_numpy(), tokens)):
                x.append(y)
            if sum(map(len, held[0])) >= ANSWERS:
                yield answer()
                held = [[], [], []]
        if held[0]:
            yield answer()

    return words.repartition("word").sortWithinPartitions("word").select("block", "place", "word").mapInArrow(work, "block long, places array<int>, counts array<int>")


def _sums(blocks: pa.Table, counts: pa.Table) -> pa.Table:
    """The tokens of each document of a block."""
    parts = [counts.column(c).combine_chunks() for c in ("places", "counts")]
    place, count = (x.values.to_numpy() if len(x) else np.zeros(0, np.int32) for x in parts)
    of = np.zeros(int(place.max(initial=-1)) + 1, np.int64)
    of[place] = count
    row = {c: blocks.column(c)[0] for c in ("ids", "bytes", "sizes", "places", "times")}
    sizes = row["sizes"].values.to_numpy().astype(np.int64)
    ends = np.cumsum(sizes)
    steps = np.cumsum(_numbers(row["places"].as_py()))
    before = np.append(0, steps)[ends - sizes]  # each document's places begin anew
    place = steps - np.repeat(before, sizes)
    total = np.append(0, np.cumsum(of[place] * _numbers(row["times"].as_py())))
    return pa.table({"doc_id": row["ids"].values, "n_bytes": row["bytes"].values, "n_tokens": total[ends] - total[ends - sizes]})


def count_tokens(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """UTF-8 bytes and tokens of every whole text: doc_id, n_bytes, n_tokens.

    Tokens are those that the sentencepiece library gives for the model at ``path`` (which every
    executor must have), without begin and end marks.  It must be a BPE vocabulary that takes texts as
    they are written and has no user-defined pieces and none that spans white space; else ValueError.
    Null and empty texts have 0 of either.  One row for each input row, repeated and null ids included;
    other columns are not read.  A very long text is cut into pre-tokens piece by piece, and is a block of its own.

    Two shuffles: the distinct pre-tokens of each block by their text, and blocks with their counts
    by number.  A frequent pre-token comes once for each block, not for each document.
    """
    model = PieceModel(path)
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.octet_length(body).cast("long").alias("size"), body.alias("text"))
    blocks = materialize(document_blocks(rows, model), "blocks", codec="zstd")
    words = blocks.select("block", F.posexplode("words").alias("place", "word"))
    counts = materialize(word_counts(words, model), "counts", codec="zstd")
    both = blocks.drop("words").groupBy("block").cogroup(counts.groupBy("block"))
    return both.applyInArrow(_sums, "doc_id long, n_bytes long, n_tokens long")
