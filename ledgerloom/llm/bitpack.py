"""Token ids in fixed-width bit-packed files with block offsets.

A file holds the ids of whole documents in order.  Every id takes ``bits`` bits, the fewest that
hold the vocabulary, low bit first.  Ids are packed in blocks of ``BLOCK_IDS``; the block table
gives each block's byte offset, so any range of ids is found and unpacked with numpy alone.  Blocks
are written as they fill, so the tables stand at the end:

    packed blocks | block offsets u64 x (blocks + 1) | document ends u64 x documents
    doc_ids i64 x documents | null marks u8 x documents
    magic "LLBP" | bits u32 | ids per block u32 | blocks u32 | documents u64 | ids u64

Files are written by the tasks through ``pyarrow.fs`` into the shared folder, one for each range
of doc_ids, under a name that is unique to the attempt; the manifest row that a task returns is
what makes a file count, so a lost or repeated attempt leaves nothing that is read.
"""

from __future__ import annotations

import contextlib
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import caches, lean_worker, shared_path

MAGIC, HEAD = b"LLBP", struct.Struct("<4sIIIQQ")
BLOCK_IDS = 1 << 14
PART_BYTES = 32 << 20
MANIFEST = "part int, path string, first_id long, n_docs long, n_ids long, bytes long"


def bits_for(vocabulary: int) -> int:
    """The fewest bits that hold every id below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids end to end at ``bits`` bits each."""
    if bits == 16:
        return ids.astype("<u2").tobytes()
    if bits == 8:
        return ids.astype(np.uint8).tobytes()
    flags = (ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(flags.astype(np.uint8).reshape(-1), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, count: int) -> np.ndarray:
    """The first ``count`` ids of packed ``data``."""
    if bits == 16:
        return np.frombuffer(data, "<u2", count).astype(np.uint32)
    if bits == 8:
        return np.frombuffer(data, np.uint8, count).astype(np.uint32)
    flags = np.unpackbits(np.frombuffer(data, np.uint8), count=count * bits, bitorder="little").reshape(count, bits)
    return (flags.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


class PackedWriter:
    """Packs ids as they come and writes every block that is full; what it holds is one block and the tables."""

    def __init__(self, stream, bits: int, block: int = BLOCK_IDS):
        self.stream, self.bits, self.block = stream, bits, block
        self.rest: list[np.ndarray] = []
        self.held = self.total = 0
        self.offsets, self.ends, self.doc_ids, self.null = array("Q", [0]), array("Q"), array("q"), bytearray()

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.total += len(ids)
        self.ends.append(self.total)
        self.doc_ids.append(doc_id or 0)
        self.null.append(doc_id is None)
        self.rest.append(ids)
        self.held += len(ids)
        if self.held >= self.block:
            ids = np.concatenate(self.rest)
            full = len(ids) // self.block * self.block
            for i in range(0, full, self.block):
                self._put(ids[i : i + self.block])
            self.rest, self.held = [ids[full:]], len(ids) - full

    def _put(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        self.stream.write(data)
        self.offsets.append(self.offsets[-1] + len(data))

    def close(self) -> int:
        """Write what is left and the tables; returns the file's size."""
        if self.held:
            self._put(np.concatenate(self.rest))
        head = HEAD.pack(MAGIC, self.bits, self.block, len(self.offsets) - 1, len(self.ends), self.total)
        parts = [np.array(self.offsets, "<u8").tobytes(), np.array(self.ends, "<u8").tobytes(), np.array(self.doc_ids, "<i8").tobytes(), bytes(self.null), head]
        for part in parts:
            self.stream.write(part)
        return self.offsets[-1] + sum(map(len, parts))


class PackedReader:
    """Random access to the documents of a file, and one pass over them."""

    def __init__(self, stream):
        self.stream = stream
        size = stream.seek(0, 2)
        size = stream.tell() if size is None else size
        stream.seek(size - HEAD.size)
        magic, self.bits, self.block, blocks, docs, self.total = HEAD.unpack(stream.read(HEAD.size))
        if magic != MAGIC:
            raise ValueError("not a packed token file")
        stream.seek(size - HEAD.size - 17 * docs - 8 * (blocks + 1))
        read = lambda kind, n: np.frombuffer(stream.read(n * np.dtype(kind).itemsize), kind)
        self.offsets, self.ends, self._ids, self._null = read("<u8", blocks + 1), read("<u8", docs), read("<i8", docs), read(np.uint8, docs)

    def _block(self, b: int) -> np.ndarray:
        data = self.stream.read(int(self.offsets[b + 1] - self.offsets[b]))
        return unpack(data, self.bits, min(self.block, self.total - b * self.block))

    def ids(self, first: int, last: int) -> np.ndarray:
        """The ids numbered from ``first`` to before ``last``."""
        if last <= first:
            return np.zeros(0, np.uint32)
        b0, b1 = first // self.block, (last - 1) // self.block
        self.stream.seek(int(self.offsets[b0]))
        return np.concatenate([self._block(b) for b in range(b0, b1 + 1)])[first - b0 * self.block : last - b0 * self.block]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, number of its first id, ids) of each document in order; each block is read once."""
        self.stream.seek(0)
        held, held_from, b, first = np.zeros(0, np.uint32), 0, 0, 0
        for doc, null, end in zip(self._ids.tolist(), self._null.tolist(), self.ends.tolist()):
            if held_from + len(held) < end:
                parts = [held[first - held_from :]]
                held_from, upto = first, held_from + len(held)
                while upto < end:
                    parts.append(self._block(b))
                    upto, b = upto + len(parts[-1]), b + 1
                held = np.concatenate(parts)
            yield None if null else doc, first, held[first - held_from : end - held_from]
            first = end


class ChunkEncoder:
    """The library's ids of whole texts, with each distinct chunk between white space encoded once.

    The tokenizer drops white space and no token spans it, so a text's ids are those of its
    chunks in order.  Texts that hold one of the tokenizer's special strings, or a character
    that only Python takes for white space, go to the library whole.  The cache is bounded; when it is full it starts anew.
    """

    def __init__(self, path: str, most: int = 1_500_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.most, self.cache = most, dict[str, bytes]()
        # Four control characters split words in Python and are no white space to the tokenizer.
        self.special = [*(t.content for t in self.tokenizer.get_added_tokens_decoder().values()), *map(chr, range(28, 32))]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def _learn(self, fresh: list[str]) -> None:
        """Put the ids of new chunks into the cache."""
        words, rest = [c for c in fresh if c.isalpha()], [c for c in fresh if not c.isalpha()]
        # Letters only make one word each, whose last token is marked; so many go to the library as one text.
        for i in range(0, len(words), 2_000):
            part = words[i : i + 2_000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            cut = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(cut) != len(part):
                rest += part
                continue
            raw = ids.tobytes()
            self.cache.update(zip(part, (raw[a:b] for a, b in zip([0, *cut[:-1]], cut))))
        for i in range(0, len(rest), 2_000):
            part = rest[i : i + 2_000]
            for chunk, got in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                self.cache[chunk] = array("I", got.ids).tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        # The tokenizer lower-cases anyway; doing so first makes fewer distinct chunks.
        chunks = [() if any(s in t for s in self.special) else (t.lower() if t.isascii() else t).split() for t in texts]
        if len(self.cache) > self.most:
            self.cache = {}
        self._learn(list(set().union(*chunks).difference(self.cache)))
        ids, out = self.cache.__getitem__, []
        for text, words in zip(texts, chunks):
            if words == ():
                out.append(np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32))
            else:
                out.append(np.frombuffer(b"".join(map(ids, words)), np.uint32))
        return out


def _encoder(path: str) -> ChunkEncoder:
    found = _encoders.get(path)
    if found is None:
        found = _encoders[path] = ChunkEncoder(path)
    return found


_encoders: dict[str, ChunkEncoder] = caches.setdefault("packed", {})


def _open(path: str):
    system, inner = fs.FileSystem.from_uri(path)
    return system, inner


def vocabulary_size(tokenizer: str) -> int:
    """One more than the largest id of a tokenizer file, added tokens included."""
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(tokenizer).get_vocab(with_added_tokens=True).values()) + 1


def write_packed(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 2, vocabulary: int | None = None, parts: int | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode all texts and write them in ascending doc_id order; returns the manifest of the files.

    Null doc_ids come first, equal ones by a hash of their texts, so that one id may fill several
    files; null texts hold only the end id.  A file holds about ``PART_BYTES`` of text.  An empty
    table writes no file.  ``folder`` is a URI that all executors reach; ``vocabulary`` is the
    tokenizer's own where it is not given.
    """
    bits = bits_for(max(vocabulary or vocabulary_size(tokenizer), end_id + 1))
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.xxhash64(f"`{text}`").alias("mark"))
    if parts is None:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        parts = max(1, -(-size // PART_BYTES))
    order = [F.col("doc_id").asc_nulls_first(), F.col("mark")]
    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text", F.spark_partition_id().alias("part"))

    def work(batches: Iterable[pa.RecordBatch]):
        lean_worker("packed")
        encoder, writer, part, first = _encoder(tokenizer), None, None, None
        end = np.array([end_id], np.uint32)
        with contextlib.ExitStack() as files:
            for batch in batches:
                for i in range(0, batch.num_rows, 500):
                    piece = batch.slice(i, 500)
                    ids = piece.column(0).to_pylist()
                    if writer is None:
                        part, first = piece.column(2)[0].as_py(), ids[0]
                        path = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.llbp"
                        system, inner = _open(path)
                        system.create_dir(inner.rpartition("/")[0], recursive=True)
                        writer = PackedWriter(files.enter_context(system.open_output_stream(inner)), bits)
                    for doc, tokens in zip(ids, encoder.encode([x or "" for x in piece.column(1).to_pylist()])):
                        writer.add(doc, np.concatenate([tokens, end]))
            size = writer.close() if writer else 0
        if writer:
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [path], "first_id": pa.array([first], pa.int64()), "n_docs": [len(writer.ends)], "n_ids": [writer.total], "bytes": [size]})

    return ordered.mapInArrow(work, MANIFEST)


def read_packed(manifest: DataFrame) -> DataFrame:
    """One row for each document of the files: doc_id, start (number of its first id over all files), ids' count and crc32.

    Files follow each other by part, documents in a file as they were written.  An empty manifest
    gives no rows.  A document of any length is read block by block.
    """
    spark = manifest.sparkSession
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    files = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    files = files.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "part")

    def work(batches):
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                system, inner = _open(path)
                with system.open_input_file(inner) as stream:
                    out: list[tuple] = []
                    for doc, first, ids in PackedReader(stream).documents():
                        out.append((doc, base + first, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        if len(out) == 10_000:
                            yield _rows(out)
                            out = []
                    if out:
                        yield _rows(out)

    return files.select("path", "base").mapInArrow(work, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def pack_and_read(docs: DataFrame, tokenizer: str, end_id: int = 2, vocabulary: int | None = None) -> DataFrame:
    """Write all documents into the shared folder and read the files back: one row for each, as ``read_packed`` has it.

    Documents go by ascending doc_id, nulls first, equal ids by a hash of their texts; null and empty texts have
    the end id only; repeated rows are written as often as they come.  Texts may have any length.
    The files stay in the shared folder.
    """
    spark: SparkSession = docs.sparkSession
    manifest = write_packed(docs, tokenizer, shared_path(spark, "packed"), end_id, vocabulary)
    rows = manifest.collect()  # one row for each file
    return read_packed(spark.createDataFrame(rows, MANIFEST))
