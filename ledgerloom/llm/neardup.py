"""Near-duplicate documents: SuperMinHash signatures, banding, exact verification, union-find.

Signatures follow SuperMinHash (Ertl, 2017): in round j an element draws a value from [j, j+1)
for the j-th place of its own random permutation of the positions, so its ranks at different
positions are correlated and the estimate has a lower variance than MinHash.  A document is done
as soon as every position holds a value that later rounds cannot undercut; a long document stops
after one or two rounds.

Documents with equal shingle sets are one *node*.  Nodes that share a band bucket are candidates:
the node of a bucket that meets most others is verified against the rest first (no pair list of a
bucket is ever built), and only in buckets that still hold several components afterwards are pairs
between different components verified as well, unless the prefix filter or set sizes, which are
exact, rule the link out.  Links are confirmed on the full shingle sets, so a
component is a component of the exact similarity graph over all candidates.  With 24 bands of 4
rows a pair at similarity 0.85 misses all bands with probability 2e-8.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NOT_SPACE, clear_path, fresh_name, lean_worker, materialize, mix64, row_blocks, sorted_pairs, text_bytes, text_key, word_spans
from .components import connected_components

POSITIONS, ROWS = 96, 4
#: Parts over which the rows of a large group are dealt when they get their name.
PARTS = 16


def shingle_sets(buf: np.ndarray, offs: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each distinct word shingle; a row with fewer words is one shingle, one without words has none."""
    _, _, rows, h = word_spans(buf, offs, NOT_SPACE)
    n = len(offs) - 1
    count = np.bincount(rows, minlength=n)
    first = np.concatenate([[0], np.cumsum(count)])
    size = np.maximum(1, count - words + 1) * (count > 0)
    row = np.repeat(np.arange(n), size)
    at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first[:-1], size)
    end = np.repeat(first[1:], size)
    value = np.zeros(len(row), np.uint64)
    for k in range(words):
        i = at + k
        inside = i < end
        value = mix64(value * np.uint64(0x9E3779B97F4A7C15) + np.where(inside, h[np.minimum(i, max(len(h) - 1, 0))], np.uint64(0)) + np.uint64(k + 1)) if len(h) else value
    return sorted_pairs(row, value)[:2]


def super_minhash(rows: np.ndarray, values: np.ndarray, n: int, positions: int = POSITIONS) -> np.ndarray:
    """The n x positions signatures of sets given as (row, element), sorted by row; uint32, least wins."""
    sig = np.full(n * positions, np.uint32(0xFFFFFFFF), np.uint32)
    el_row, el = rows, values
    places = None
    for j in range(positions):
        if not len(el):
            break
        draw = mix64(el * np.uint64(2 * positions) + np.uint64(j + 1))
        value = np.uint32(j << 25) | (draw >> np.uint64(39)).astype(np.uint32)
        k = j + ((draw & np.uint64(0xFFFFFFFF)) * np.uint64(positions - j) >> np.uint64(32)).astype(np.int64)
        if places is None:
            chosen = k
        else:
            at = np.arange(len(el))
            chosen = places[at, k].astype(np.int64)
            places[at, k] = places[at, j]
        np.minimum.at(sig, el_row * positions + chosen, value)
        settled = sig.reshape(n, positions).max(axis=1) < np.uint32((j + 1) << 25) if j < 95 else np.ones(n, bool)
        active = ~settled[el_row]
        if places is None:
            if active.any():
                k, el_row, el = k[active], el_row[active], el[active]
                places = np.tile(np.arange(positions, dtype=np.uint8), (len(el), 1))
                places[np.arange(len(el)), k] = 0
            else:
                break
        elif not active.all():
            el_row, el, places = el_row[active], el[active], places[active]
    return sig.reshape(n, positions)


def set_node(rows: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit identity of each row's set, and the set's size."""
    size = np.bincount(rows, minlength=n)
    parts = [np.zeros(n, np.uint64), np.zeros(n, np.uint64)]
    for part, salt in zip(parts, (0x51ED2701, 0xB5297A4D)):
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix64(values + np.uint64(salt)))])
        first = np.concatenate([[0], np.cumsum(size)])
        part[:] = total[first[1:]] - total[first[:-1]]
    return mix64(mix64(parts[0]) ^ (parts[1] + size.astype(np.uint64))).astype(np.int64), size


PROFILE = "doc_id long, tkey long, node long, n_shingles long, bands array<long>, sketch binary"


def profile(docs: DataFrame, words: int, doc_id: str, text: str, positions: int, rows_per_band: int) -> DataFrame:
    def work(batches):
        lean_worker()
        for batch in batches:
            buf, offs = text_bytes(batch.column(2))
            for a, b in row_blocks(offs):
                local = offs[a : b + 1] - offs[a]
                rows, values = shingle_sets(buf[offs[a] : offs[b]], local, words)
                n = b - a
                node, size = set_node(rows, values, n)
                sig = super_minhash(rows, values, n, positions)
                bands = positions // rows_per_band
                flat = np.zeros((n, bands), np.uint64)
                for r in range(rows_per_band):
                    flat = mix64(flat * np.uint64(0x9E3779B97F4A7C15) + sig[:, r::rows_per_band][:, :bands].astype(np.uint64) + np.uint64(r + 1))
                flat = mix64(flat + np.arange(bands, dtype=np.uint64))
                sketch = np.ascontiguousarray((sig & np.uint32(255)).astype(np.uint8))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, n),
                        batch.column(1).slice(a, n),
                        pa.array(node, pa.int64()),
                        pa.array(size, pa.int64()),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, n * bands + 1, bands), pa.int32()), pa.array(flat.reshape(-1).astype(np.int64))),
                        pa.array([x.tobytes() for x in sketch], pa.binary()),
                    ],
                    names=["doc_id", "tkey", "node", "n_shingles", "bands", "sketch"],
                )

    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), text_key(F.col(f"`{text}`")).alias("tkey"), F.col(f"`{text}`").alias("text")).mapInArrow(work, PROFILE)


def _verified(pairs: DataFrame, sets: DataFrame, words: int, share: Fraction) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the similarity."""
    second = sets.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    first = sets.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    both = pairs.join(second, "b").join(first, "a").select("a", "b", "text_a", "text_b")
    num, den = share.numerator, share.denominator

    def work(batches):
        lean_worker()
        for batch in batches:
            kept_a, kept_b = [], []
            last, last_set = None, None
            ids_a, ids_b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            bufs = [text_bytes(batch.column(i)) for i in (2, 3)]
            for i, (a, b) in enumerate(zip(ids_a, ids_b)):
                if a != last:
                    buf, offs = bufs[0]
                    part = buf[offs[i] : offs[i + 1]]
                    last, last_set = a, shingle_sets(part, np.array([0, len(part)]), words)[1]
                buf, offs = bufs[1]
                part = buf[offs[i] : offs[i + 1]]
                other = shingle_sets(part, np.array([0, len(part)]), words)[1]
                common = len(np.intersect1d(last_set, other, assume_unique=True))
                if common and den * common >= num * (len(last_set) + len(other) - common):
                    kept_a.append(a)
                    kept_b.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(kept_a, pa.int64()), pa.array(kept_b, pa.int64())], names=["a", "b"])

    return both.mapInArrow(work, "a long, b long")


def _plausible(pairs: DataFrame, sketches: DataFrame, floor: float) -> DataFrame:
    """Pairs whose sizes allow the similarity and whose signatures agree at ``floor`` of the positions or more.

    ``floor`` lies five standard deviations below the similarity asked for.
    """
    first = sketches.select(F.col("node").alias("a"), F.col("sketch").alias("sa"))
    second = sketches.select(F.col("node").alias("b"), F.col("sketch").alias("sb"))

    def work(batches):
        lean_worker()
        for batch in batches:
            if not batch.num_rows:
                continue
            sa, sb = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for i in (2, 3))
            good = pa.array((sa == sb).mean(axis=1) >= floor)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), batch.column(1).filter(good)], names=["a", "b"])

    return pairs.join(first, "a").join(second, "b").select("a", "b", "sa", "sb").mapInArrow(work, "a long, b long")


def _prefix_pairs(nodes: DataFrame, sets: DataFrame, words: int, share: Fraction, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Pairs (a, b) of different components whose sets may reach the similarity; none that does is missed.

    Prefix and positional filter (Xiao et al., 2008): with each set in order of rising frequency,
    two sets that are similar enough share an element among the first ones of both, and what
    follows it must still hold the overlap that is needed.  Copies of one text with many edits of
    their own begin with those, which nobody shares, so they meet nobody.
    """

    def work(batches):
        lean_worker()
        for batch in batches:
            buf, offs = text_bytes(batch.column(1))
            for a, b in row_blocks(offs):
                rows, values = shingle_sets(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a], words)
                ids = batch.column(0).slice(a, b - a).to_numpy()
                for i in range(0, len(rows), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[rows[i : i + 100_000]]), pa.array(values[i : i + 100_000].astype(np.int64))], names=["node", "shingle"])

    found = keep(sets.select("node", "text").mapInArrow(work, "node long, shingle long"), "shingles")
    often = found.groupBy("shingle").agg(F.count(F.lit(1)).alias("often"))
    place = F.row_number().over(Window.partitionBy("node").orderBy("often", "shingle")) - 1
    num, den = share.numerator, share.denominator
    first = found.join(often, "shingle").withColumn("at", place).join(nodes, "node")
    first = keep(first.where("often > 1").where(f"(n - at) * {den} >= n * {num}").drop("often"), "prefixes")
    left = first.select("shingle", F.col("node").alias("a"), "n", F.col("at").alias("pa"), F.col("comp").alias("ca"))
    right = first.select("shingle", F.col("node").alias("b"), F.col("n").alias("m"), F.col("at").alias("pb"), F.col("comp").alias("cb"))
    enough = f"least(n - pa, m - pb) * {num + den} >= (n + m) * {num}"
    # Shingles within one component link nothing new; of the others the filters are part of the join.
    several = first.groupBy("shingle").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("shingle")
    return left.join(several, "shingle", "left_semi").join(right, "shingle").where("a < b AND ca != cb").where(enough).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, words: int = 5, similarity: Fraction | str = "4/5", doc_id: str = "doc_id", text: str = "text", positions: int = POSITIONS, rows_per_band: int = ROWS) -> DataFrame:
    """Components of the graph that links documents whose word-shingle sets have that Jaccard similarity or more.

    Columns: doc_id, tkey (key of the text), n_shingles, component_id (least doc_id of the
    component), kept (doc_id is the least).  A document without words has an empty set, is linked
    with nothing and kept.  Null texts count as empty.  A null doc_id never names a component that
    has another one; a component of null ids only has a null component_id and keeps its rows.
    Repeated rows appear as often as they come, each kept or not as its doc_id says, so rows that
    share the least doc_id are all kept.  An empty table gives no rows.  Other columns are not read.
    Texts of any length are shingled whole, a block of bytes at a time.
    """
    share, spark, folders = Fraction(similarity), docs.sparkSession, list[str]()

    def keep(df: DataFrame, tag: str) -> DataFrame:
        return materialize(df, tag, folders)

    known = keep(profile(docs, words, doc_id, text, positions, rows_per_band), "profile")
    some = known.where("n_shingles > 0")
    # One row for each node: with the text of one document that has this set.
    nodes = some.groupBy("node").agg(F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "tkey", "n_shingles", "bands", "sketch")).alias("r"))
    nodes = keep(nodes.select("node", "least", "r.*"), "nodes")
    entries = nodes.select("node", F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = keep(entries.join(shared, "bucket"), "members")
    # The pivot of a bucket is the member that meets most others: in a group of edited copies, the original.
    degree = members.groupBy("node").agg(F.sum("size").alias("degree"))
    met = members.join(degree, "node")
    pivots = met.groupBy("bucket").agg(F.max(F.struct("degree", "node", "n")).alias("p")).select("bucket", F.col("p.node").alias("a"), F.col("p.n").alias("m"))
    num, den = share.numerator, share.denominator
    sized = f"least(n, m) * {den} >= greatest(n, m) * {num}"
    floor = max(0.0, float(share) - 5 * math.sqrt(float(share) * (1 - float(share)) / positions))
    stars = members.join(pivots, "bucket").where("a != node").where(sized)
    stars = stars.select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct()
    wanted = members.select("node").distinct()
    sketches = keep(nodes.select("node", "sketch").join(wanted, "node"), "sketches")
    # The text of one document for each candidate node; copies of it do not match the doc_id and stay behind.
    homes = nodes.join(wanted, "node").select("node", F.coalesce("doc_id", F.lit(-(2**63))).alias("home"), "tkey")
    texts = docs.select(F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(-(2**63))).alias("home"), text_key(F.col(f"`{text}`")).alias("tkey"), F.col(f"`{text}`").alias("text"))
    sets = keep(texts.join(homes, ["home", "tkey"]).select("node", "text").dropDuplicates(["node"]), "sets")
    links = keep(_verified(_plausible(stars, sketches, floor), sets, words, share), "links")
    groups = keep(connected_components(links), "groups")
    # Buckets that still hold several components: their pairs across components, those that signatures had ruled out too.
    labelled = members.join(groups, "node", "left").select("bucket", "node", "n", F.coalesce("root", "node").alias("comp"))
    split = labelled.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("bucket")
    open_nodes = keep(labelled.join(split, "bucket").select("node", "n", "comp").distinct(), "open")
    crossing = _prefix_pairs(open_nodes, sets.join(open_nodes.select("node"), "node"), words, share, keep)
    more = keep(_verified(crossing, sets, words, share), "more")
    if more.limit(1).count():
        groups = keep(connected_components(links.unionByName(more)), "groups")
    # Nodes outside of all groups name themselves; the rest take the least doc_id, whose rows are dealt out for large groups.
    ids = nodes.select("node", "least")
    grouped = groups.join(ids, "node")
    least = grouped.groupBy("root").agg(F.min("least").alias("component_id")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    grouped = grouped.withColumn("part", F.pmod(F.col("node"), F.lit(PARTS)).cast("int")).join(least, ["root", "part"]).select("node", "component_id")
    alone = ids.join(groups, "node", "left_anti").select("node", F.col("least").alias("component_id"))
    named = keep(grouped.unionByName(alone), "named")
    for folder in folders[1:-1]:  # all but the profile and the names
        clear_path(spark, folder)
    out = known.join(named, "node", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "tkey", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one_each(docs: DataFrame, words: int = 5, similarity: Fraction | str = "4/5", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents of which one stays from each group: whole rows, all columns.

    Of rows with the same doc_id and text one is kept.  Null texts count as empty, and documents
    without words are kept; a null doc_id stays only where its group has no other id, or its text
    has no words.  Columns may have any name; texts may be of any length; no rows give no rows.
    """
    home, key = fresh_name("home", docs.columns), fresh_name("key", docs.columns)
    kept = near_duplicates(docs, words, similarity, doc_id, text).where("kept").select(F.coalesce("doc_id", F.lit(-(2**63))).alias(home), F.col("tkey").alias(key)).distinct()
    own = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.select(*own, F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(-(2**63))).alias(home), text_key(F.col(f"`{text}`")).alias(key))
    return keyed.join(kept, [home, key]).dropDuplicates([home, key]).select(*own)
