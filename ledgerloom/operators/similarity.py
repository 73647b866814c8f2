"""Vector search and similarity joins.

Searches meet in tiles of queries and vectors.  Similarity self-joins run inside blocks (tenant and record type).  A block is cut into
tiles of at most ``TILE`` vectors and a task gets one pair of tiles, so neither a large tenant
nor one that holds a third of all rows ever sits in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package

TILE = 2048
#: Cells of a block, about, at most; larger cells are cut into more tiles.
MOST_PIVOTS = 1024


def _matrix(column: pa.ListArray, size: int) -> np.ndarray:
    """Rows of unit length; a zero vector stays zero."""
    m = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


def check_dimension(vectors: DataFrame, size: int, column: str = "embedding") -> DataFrame:
    """Rows whose vector has that many numbers, none of them null; others raise when they are produced."""
    good = (F.size(column) == size) & ~F.exists(column, lambda x: x.isNull())
    return vectors.withColumn(column, F.when(good, F.col(column)).otherwise(F.raise_error(F.lit(f"vector without {size} numbers")).cast(vectors.schema[column].dataType)))


def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """L2: the ``k`` (1..50) best rows."""
    if not 1 <= k <= 50:
        raise ValueError("k must be between 1 and 50")
    return df.orderBy(*order).limit(k)


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int, size: int, query_id: str = "query_id", vec_id: str = "vec_id", column: str = "embedding", block: str | None = None, most: int = 50) -> DataFrame:
    """For each query the ``k`` (1 to ``most``) vectors of highest cosine, ties by id.

    Columns: query_id, vec_id (numbers or strings, as they come), similarity, rank.  With ``block`` only
    vectors of the query's own block count.  Queries and vectors are dealt to tiles of at most ``TILE``
    rows; a task meets one tile of each and returns its best ``k`` of each query, so nothing passes
    through the driver and what is shuffled is queries x k x vector tiles rows.  A vector is sent once
    for each query tile.
    """
    if not 1 <= k <= most:
        raise ValueError(f"k must be between 1 and {most}")
    ship_package(queries.sparkSession)
    own = lambda df, key, name: df.select(F.col(key).alias(name), F.col(column).cast("array<float>").alias("v"), (F.col(block).cast("string") if block else F.lit("")).alias("b"))
    wanted, rows = own(queries, query_id, "q"), own(vectors, vec_id, "i")
    kinds = wanted.schema["q"].dataType.simpleString(), rows.schema["i"].dataType.simpleString()
    sizes = wanted.agg(F.count(F.lit(1)).alias("q")).crossJoin(rows.agg(F.count(F.lit(1)).alias("v"))).first()  # two counts
    across, down = max(1, -(-sizes["q"] // TILE)), max(1, -(-sizes["v"] // (4 * TILE)))
    tile = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    asked = wanted.select("q", F.lit(None).cast(kinds[1]).alias("i"), "v", "b", F.lit(True).alias("ask"), tile("q", across).alias("x"), F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("y"))
    given = rows.select(F.lit(None).cast(kinds[0]).alias("q"), "i", "v", "b", F.lit(False).alias("ask"), F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("x"), tile("i", down).alias("y"))

    def best(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        ask = group.column("ask").to_numpy()
        keys, ids = (group.column(c).filter(pa.array(mask)).combine_chunks() for c, mask in (("q", ask), ("i", ~ask)))
        m, blocks = _matrix(group.column("v").combine_chunks(), size), group.column("b").combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
        order = pc.sort_indices(ids)  # equal values keep the order of ids
        ids, v, q = ids.take(order), np.flatnonzero(~ask)[order.to_numpy()], np.flatnonzero(ask)
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
        for own in np.intersect1d(blocks[q], blocks[v]):
            asks, gives = np.flatnonzero(blocks[q] == own), np.flatnonzero(blocks[v] == own)
            given, least = m[v[gives]].T, min(k, len(gives))
            for start in range(0, len(asks), 256):
                part = asks[start : start + 256]
                sims = m[q[part]] @ given
                floor = np.partition(sims, sims.shape[1] - least, axis=1)[:, sims.shape[1] - least]
                r, c = np.nonzero(sims >= floor[:, None] - 1e-11)
                near = np.round(sims[r, c], 12)  # as equal vectors may differ in the last bits from tile to tile
                at = np.lexsort((c, -near, r))
                r, c, near = r[at], c[at], near[at]
                place = np.arange(len(r)) - np.searchsorted(r, r)
                for o, x in zip(out, (part[r], gives[c], near)):
                    o.append(x[place < k])
        rows_, found, sims = map(np.concatenate, out)
        return pa.table({"query_id": keys.take(pa.array(rows_)), "vec_id": ids.take(pa.array(found)), "similarity": sims})

    found = asked.unionByName(given).groupBy("x", "y").applyInArrow(best, f"query_id {kinds[0]}, vec_id {kinds[1]}, similarity double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _cells(rows: DataFrame, floor: float, size: int, tile: int) -> DataFrame:
    """Each vector in its own cell, and in those where a partner of a lesser cell could be.

    Of a block of more than ``tile`` vectors about one in ``tile`` (by a hash of its id) is a pivot; a
    vector's own cell is that of the nearest pivot.  With u the angle of ``floor``, a partner y of a
    vector x in the cell of p is at most u from x, and x is as near to p as to y's own pivot q, so
    angle(y, p) <= angle(y, q) + 2u.  No other cell can hold a partner.
    """
    counts = rows.groupBy("block").agg(F.count(F.lit(1)).alias("n"))
    counted = rows.join(counts, "block")
    alone = counted.where(F.col("n") <= tile).select("i", "v", "block", F.lit(0).alias("cell"), F.lit(0).alias("own"))
    large = counted.where(F.col("n") > tile)
    dealt = F.pmod(F.xxhash64("i"), F.lit(1 << 30)) / float(1 << 30)
    pivots = large.where(dealt * F.col("n") < F.least(F.col("n") / tile, F.lit(float(MOST_PIVOTS)))).select("block", "i", "v", "n")
    chunks = F.ceil(F.col("n") / (8 * tile)).cast("int")
    chunked = large.select("block", F.pmod(F.xxhash64("i", F.lit(1)), chunks).cast("int").alias("chunk"), "i", "v")
    sent = pivots.select(F.col("block").alias("pivot_block"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("pivot_chunk"), F.col("i").alias("pivot"), F.col("v").alias("at"))
    reach = 2 * float(np.arccos(np.clip(floor, -1, 1))) + 1e-6

    def assign(vectors: pa.Table, near: pa.Table) -> pa.Table:
        if not vectors.num_rows:
            return vectors.select(["i", "v", "block"]).append_column("cell", pa.array([], pa.int32())).append_column("own", pa.array([], pa.int32()))
        m = _matrix(vectors.column("v").combine_chunks(), size)
        if near.num_rows:
            near = near.sort_by("pivot")
            p = _matrix(near.column("at").combine_chunks(), size)
            row, cell, own = [], [], []
            for start in range(0, len(m), 1024):
                angle = np.arccos(np.clip(m[start : start + 1024] @ p.T, -1, 1))
                home = angle.argmin(axis=1)
                least = angle[np.arange(len(angle)), home]
                # The own cell, and lesser ones within reach: a pair of two cells meets in the lesser one.
                r, c = np.nonzero((angle <= least[:, None] + reach) & (np.arange(len(p))[None, :] <= home[:, None]))
                row.append(start + r)
                cell.append(c)
                own.append(home[r])
            row, cell, own = map(np.concatenate, (row, cell, own))
        else:
            row, cell, own = np.arange(len(m)), np.zeros(len(m), int), np.zeros(len(m), int)
        out = vectors.select(["i", "v", "block"]).take(pa.array(row))
        return out.append_column("cell", pa.array(cell, pa.int32())).append_column("own", pa.array(own, pa.int32()))

    kind = rows.schema["i"].dataType.simpleString()
    placed = chunked.groupBy("block", "chunk").cogroup(sent.groupBy("pivot_block", "pivot_chunk")).applyInArrow(assign, f"i {kind}, v array<double>, block string, cell int, own int")
    return alone.unionByName(placed)


def similar_pairs(vectors: DataFrame, floor: float, size: int, block: list[str], id_col: str = "vec_id", column: str = "embedding", tile: int = TILE) -> DataFrame:
    """Unordered pairs (a < b, similarity) inside blocks with cosine at the floor or above; exact.

    Large blocks are parted into cells around pivots, and a vector is sent only to cells that can hold
    a partner (``_cells``): the higher the floor, the fewer.  A cell is cut into tiles of about ``tile``
    vectors, and a task gets two of them, so no cell has to fit in one task either.  Ids may be
    numbers or strings.
    """
    ship_package(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).alias("i"), F.col(column).cast("array<double>").alias("v"), F.to_json(F.struct(*block)).alias("block"))
    kind = rows.schema["i"].dataType.simpleString()
    # Vectors that live in a cell meet each other and its guests, which do not meet each other.
    placed = _cells(rows, floor, size, tile).withColumn("guest", F.col("own") != F.col("cell"))
    parts = placed.groupBy("block", "cell").agg(F.ceil(F.count_if(~F.col("guest")) / tile).cast("int").alias("homes"), F.ceil(F.count_if("guest") / tile).cast("int").alias("guests"))
    met = placed.join(parts, ["block", "cell"])
    number = F.pmod(F.xxhash64("i", F.lit(2)), F.when(F.col("guest"), F.col("guests")).otherwise(F.col("homes"))).cast("int")
    met = met.withColumn("t", number + F.when(F.col("guest"), F.col("homes")).otherwise(0))
    # Tiles are numbered homes first; two tiles meet as (least, greatest), one of them of homes.
    others = F.sequence(F.lit(0), F.when(F.col("guest"), F.col("homes") - 1).otherwise(F.col("homes") + F.col("guests") - 1))
    sent = met.where(F.col("homes") > 0).withColumn("o", F.explode(others)).withColumns({"lo": F.least("t", "o"), "hi": F.greatest("t", "o")})

    def pairs(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        ids, tiles, lo, hi = group.column("i"), *(group.column(c).to_numpy() for c in ("t", "lo", "hi"))
        order = pc.rank(ids, tiebreaker="min").to_numpy().astype(np.int64)
        m = _matrix(group.column("v").combine_chunks(), size)
        x, y = np.flatnonzero(tiles == lo[0]), np.flatnonzero(tiles == hi[0])
        out_a, out_b, out_s = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for start in range(0, len(x), 512):
            part = x[start : start + 512]
            sims = m[part] @ m[y].T
            r, c = np.nonzero(sims >= floor)
            a, b, s = part[r], y[c], sims[r, c]
            keep = order[a] < order[b] if lo[0] == hi[0] else order[a] != order[b]
            a, b, s = a[keep], b[keep], s[keep]
            turn = order[a] > order[b]
            out_a.append(np.where(turn, b, a))
            out_b.append(np.where(turn, a, b))
            out_s.append(s)
        a, b, s = map(np.concatenate, (out_a, out_b, out_s))
        return pa.table({"a": ids.take(pa.array(a)), "b": ids.take(pa.array(b)), "similarity": s})

    return sent.select("i", "v", "t", "lo", "hi", "block", "cell").groupBy("block", "cell", "lo", "hi").applyInArrow(pairs, f"a {kind}, b {kind}, similarity double")


def near_duplicate_pairs(decisions: DataFrame, floor: float = 0.96, size: int = 1024, block: list[str] | None = None, id_col: str = "id", created: str = "created_at", method: str = "exact", bands: int = 16, bits: int = 12) -> DataFrame:
    """(older, newer, similarity) of live rows of a block, the older one created first.

    Rows of equal time are no pair.  ``method="lsh"`` takes candidates from random hyperplanes
    (approximate: pairs that share no band are missed) and verifies them.
    """
    block = block or ["tenant_id", "record_type"]
    live = decisions.where(F.col("superseded_by").isNull()) if "superseded_by" in decisions.columns else decisions
    found = similar_pairs(live, floor, size, block, id_col) if method == "exact" else lsh_pairs(live, floor, size, block, id_col, bands=bands, bits=bits)
    at = live.select(F.col(id_col).alias("i"), F.col(created).alias("at"))
    met = found.join(at.select(F.col("i").alias("a"), F.col("at").alias("ta")), "a").join(at.select(F.col("i").alias("b"), F.col("at").alias("tb")), "b").where("ta != tb")
    first = F.col("ta") < F.col("tb")
    return met.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("older"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("newer"), "similarity")


def lsh_pairs(vectors: DataFrame, floor: float, size: int, block: list[str], id_col: str = "vec_id", column: str = "embedding", bands: int = 16, bits: int = 12, seed: int = 3) -> DataFrame:
    """Approximate pairs: sign bits of random hyperplanes in bands, an equi-join on them, then the exact cosine."""
    ship_package(vectors.sparkSession)
    planes = np.random.default_rng(seed).normal(size=(size, bands * bits))
    rows = vectors.select(F.col(id_col).cast("long").alias("i"), F.col(column).cast("array<double>").alias("v"), F.to_json(F.struct(*block)).alias("block"))

    def sign(batches):
        for batch in batches:
            if batch.num_rows:
                m = _matrix(batch.column(1), size)
                codes = ((m @ planes) > 0).reshape(len(m), bands, bits) @ (1 << np.arange(bits))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(m), pa.list_(pa.float64())), batch.column(2), pa.array(list(codes.astype(np.int64)), pa.list_(pa.int64()))], names=["i", "v", "block", "codes"])

    signed = rows.mapInArrow(sign, "i long, v array<double>, block string, codes array<long>")
    keyed = signed.select("i", "block", F.posexplode("codes").alias("band", "code"))
    other = keyed.select(F.col("i").alias("b"), "block", "band", "code")
    near = keyed.select(F.col("i").alias("a"), "block", "band", "code").join(other, ["block", "band", "code"]).where("a < b").select("a", "b").distinct()
    unit = signed.select("i", "v")
    met = near.join(unit.select(F.col("i").alias("a"), F.col("v").alias("va")), "a").join(unit.select(F.col("i").alias("b"), F.col("v").alias("vb")), "b")
    cos = F.aggregate(F.zip_with("va", "vb", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return met.select("a", "b", cos.alias("similarity")).where(F.col("similarity") >= floor)


def conflict_candidates(vectors: DataFrame, floor: float = 0.72, k: int = 3, size: int = 1024, block: list[str] | None = None, id_col: str = "id", new_ids: DataFrame | None = None) -> DataFrame:
    """For each (new) row its ``k`` most similar others of the tenant at the floor or above.

    With ``new_ids`` only those rows are compared with the others of their block, as a search of each.
    """
    block = block or ["tenant_id"]
    if new_ids is not None:
        keyed = vectors.select(id_col, "embedding", F.to_json(F.struct(*block)).alias("_block"))
        asked = keyed.join(new_ids.select(F.col("id").alias(id_col)).distinct(), id_col, "left_semi")
        near = vector_topk(asked, keyed, k + 1, size, id_col, id_col, block="_block")  # the row itself is one of them
        both = near.where((F.col("query_id") != F.col("vec_id")) & (F.col("similarity") >= floor)).select(F.col("query_id").alias("id"), F.col("vec_id").alias("other_id"), "similarity")
    else:
        pairs = similar_pairs(vectors, floor, size, block, id_col)
        both = pairs.select(F.col("a").alias("id"), F.col("b").alias("other_id"), "similarity").unionByName(pairs.select(F.col("b").alias("id"), F.col("a").alias("other_id"), "similarity"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("similarity"), "other_id"))
    return both.withColumn("rank", rank).where(F.col("rank") <= k)


def mark_superseded(decisions: DataFrame, pairs: DataFrame, id_col: str = "id", pointer: str = "superseded_by") -> DataFrame:
    """Each older row points at the most similar newer one (least id of equal ones); pointers that are set stay.  Ids are unique over all tenants."""
    best = pairs.groupBy("older").agg(F.max(F.struct(F.col("similarity"), (-F.col("newer")).alias("n"))).alias("m")).select(F.col("older").alias(id_col), (-F.col("m.n")).alias("_new"))
    kind = decisions.schema[pointer].dataType
    return decisions.join(best, id_col, "left").withColumn(pointer, F.coalesce(pointer, F.col("_new").cast(kind))).drop("_new")


def near_dup_pair_report(pairs: DataFrame, n: int = 30) -> DataFrame:
    """The best pairs, similarity to 4 places, with the number of all."""
    total = pairs.agg(F.count(F.lit(1)).alias("total"))
    top = pairs.orderBy(F.desc("similarity"), "older", "newer").limit(n)
    return top.withColumn("similarity", F.round("similarity", 4)).crossJoin(F.broadcast(total))  # the total is one row


def purge_supersede_leaves(decisions: DataFrame, id_col: str = "id", pointer: str = "superseded_by") -> DataFrame:
    """The register without superseded rows that no other row points to.  Ids are unique over all tenants."""
    targets = decisions.where(F.col(pointer).isNotNull()).select(F.col(pointer).alias(id_col)).distinct()
    leaves = decisions.where(F.col(pointer).isNotNull()).join(targets, id_col, "left_anti").select(id_col)
    return decisions.join(leaves, id_col, "left_anti")


def detect_conflicts(decisions: DataFrame, candidates: DataFrame, labels: DataFrame, floor: float = 0.6) -> tuple[DataFrame, DataFrame]:
    """Labelled candidate pairs applied: (register with duplicates superseded, contradiction edges).

    ``labels`` has id, other_id, relationship, reason, confidence.  Of duplicates the older row is
    superseded; of equal age the other side of the new row counts as older.
    """
    sure = candidates.join(labels, ["id", "other_id"]).where(F.col("confidence") >= floor)
    at = decisions.select("id", "created_at")
    met = sure.join(at, "id").join(at.select(F.col("id").alias("other_id"), F.col("created_at").alias("other_at")), "other_id")
    mine_older = F.col("created_at") < F.col("other_at")
    pairs = met.where(F.col("relationship") == "duplicates").select(F.when(mine_older, F.col("id")).otherwise(F.col("other_id")).alias("older"), F.when(mine_older, F.col("other_id")).otherwise(F.col("id")).alias("newer"), "similarity")
    edges = met.where(F.col("relationship") == "contradicts").groupBy(F.col("id").alias("decision_id"), F.col("other_id").alias("related_decision_id")).agg(F.max_by("reason", "confidence").alias("reason"), F.max("confidence").alias("confidence"))
    return mark_superseded(decisions, pairs), edges
