"""Best-fit-decreasing packing of indivisible groups of rows into shards.

Rows with equal texts form a group.  Groups enter, from the largest down, the shard whose
remaining capacity is the tightest that still holds them; a balanced search tree keyed on
remaining capacity finds it.  ``best_fit`` opens shards of a fixed capacity as needed;
``pack_near_equal`` looks for the smallest capacity at which the same rule needs no more
than a given number of shards.

The rule sees groups only through their size, so it runs over *size classes*: how many groups
have each size.  Sizes from 65,536 up are rounded up to 11 significant bits, which bounds the
table at about 65,536 + 1,024 classes for each doubling (under 120,000 classes at any input),
so it may reach the driver and be broadcast.  Groups then take their places in the class by
rank, counted within hashed parts of it, so that a class of any size is dealt over many tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

EXACT_SIZES = 1 << 16
SIGNIFICANT_BITS = 11
#: A class of groups is ranked in at least so many hashed parts, of about so many groups each.
CLASS_PARTS, PART_GROUPS = 64, 1_000_000


class CapacityTree:
    """A size-balanced (AA) tree of (remaining capacity, shard)."""

    __slots__ = ("root",)

    def __init__(self):
        self.root = None

    def insert(self, key: tuple[int, int]) -> None:
        self.root = self._insert(self.root, key)

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Remove and return the least key whose capacity is at least ``size``."""
        node, found = self.root, None
        while node:
            if node[0] >= (size, -1):
                found, node = node[0], node[2]
            else:
                node = node[3]
        if found is not None:
            self.root = self._delete(self.root, found)
        return found

    # A node is [key, level, left, right].
    @staticmethod
    def _skew(t):
        if t and t[2] and t[2][1] == t[1]:
            left = t[2]
            t[2], left[3] = left[3], t
            return left
        return t

    @staticmethod
    def _split(t):
        if t and t[3] and t[3][3] and t[3][3][1] == t[1]:
            right = t[3]
            t[3], right[2] = right[2], t
            right[1] += 1
            return right
        return t

    def _insert(self, t, key):
        if t is None:
            return [key, 1, None, None]
        side = 2 if key < t[0] else 3
        t[side] = self._insert(t[side], key)
        return self._split(self._skew(t))

    def _delete(self, t, key):
        if t is None:
            return None
        if key != t[0]:
            side = 2 if key < t[0] else 3
            t[side] = self._delete(t[side], key)
        elif t[2] is None and t[3] is None:
            return None
        elif t[2] is None:
            near = t[3]
            while near[2]:
                near = near[2]
            t[0] = near[0]
            t[3] = self._delete(t[3], near[0])
        else:
            near = t[2]
            while near[3]:
                near = near[3]
            t[0] = near[0]
            t[2] = self._delete(t[2], near[0])
        level = min(t[2][1] if t[2] else 0, t[3][1] if t[3] else 0) + 1
        if level < t[1]:
            t[1] = level
            if t[3] and t[3][1] > level:
                t[3][1] = level
        t = self._skew(t)
        if t[3]:
            t[3] = self._skew(t[3])
            if t[3][3]:
                t[3][3] = self._skew(t[3][3])
        t = self._split(t)
        if t[3]:
            t[3] = self._split(t[3])
        return t


def best_fit(classes: list[tuple[int, int]], capacity: int, most: int | None = None) -> list[tuple[int, int, int]] | None:
    """(size, shard, how many) of best-fit-decreasing over (size, how many), or None beyond ``most`` shards.

    Equal groups that follow each other stay with the shard they have just made tightest, so a
    whole run enters it at once.  A group larger than the capacity gets a shard of its own.
    """
    tree, opened, out = CapacityTree(), 0, []
    for size, count in sorted(classes, reverse=True):
        while count:
            found = tree.take_tightest(size)
            if found is None:
                if most is not None and opened == most:
                    return None
                found, opened = (max(capacity, size), opened), opened + 1
            room, shard = found
            n = min(count, room // size)
            out.append((size, shard, n))
            tree.insert((room - n * size, shard))
            count -= n
    return out


def pack_near_equal(classes: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int]]:
    """Best-fit-decreasing at the least capacity that needs no more than ``shards`` shards.

    Groups that alone exceed the fair share of what is left get a shard each first: they cannot
    be cut, and the rest is then shared evenly by the other shards.
    """
    rest, own = sorted(classes, reverse=True), []
    while rest and shards - len(own) > 1:
        fair = sum(s * n for s, n in rest) / (shards - len(own))
        size, n = rest[0]
        if size < fair:
            break
        own.append((size, len(own), 1))
        rest = [(size, n - 1), *rest[1:]] if n > 1 else rest[1:]
    left = shards - len(own)
    total = sum(s * n for s, n in rest)
    low = high = math.ceil(total / left)
    found, step = best_fit(rest, low, left), max(1, low >> 12)
    while found is None:  # capacities a little over the fair share nearly always do
        low, high, step = high + 1, high + step, step * 2
        found = best_fit(rest, high, left)
    while high - low > total >> 18:
        middle = (low + high) // 2
        tried = best_fit(rest, middle, left)
        if tried is None:
            low = middle + 1
        else:
            high, found = middle, tried
    return own + [(s, shard + len(own), n) for s, shard, n in found]


def _size_class(size: Column) -> Column:
    """The size rounded up to ``SIGNIFICANT_BITS`` bits, or itself below ``EXACT_SIZES``."""
    unit = F.pow(F.lit(2.0), F.greatest(F.lit(0), F.length(F.bin(size)) - SIGNIFICANT_BITS)).cast("long")
    return F.when(size < EXACT_SIZES, size).otherwise(size + F.pmod(-size, unit))


def shard_rows(docs: DataFrame, shards: int | None = 16, capacity: int | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Assign every row to a shard so that equal texts stay together.

    With ``capacity`` shards are opened as best-fit-decreasing needs them (``shards`` is then
    ignored); otherwise there are ``shards`` shards of nearly equal bytes.  Returns doc_id, size
    (UTF-8 bytes + 1), text_crc32, shard and slot: a gapless number from 0 within the shard.

    Null texts count as empty, and with them form one group.  Null and repeated doc_ids are
    rows like others.  An empty table gives no rows.  Other columns are not read.  A text may have
    any length; a group larger than an even share fills a shard of its own.  Groups of one size are
    taken in the order of their hashes.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
        F.xxhash64(body).alias("_key"),
    )
    # Two texts that share key, checksum and size would only be kept together.
    group = ["_key", "text_crc32", "size"]
    groups = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_copies")).withColumn("_class", _size_class(F.col("size") * F.col("_copies")))
    groups = materialize(groups, "groups")
    counted = groups.groupBy("_class").agg(F.count(F.lit(1)).alias("n"), F.sum("_copies").alias("rows")).collect()
    classes = [(r["_class"], r["n"]) for r in counted]
    groups = groups.withColumn("_part", F.pmod(F.col("_key"), F.lit(max(CLASS_PARTS, max((n for _, n in classes), default=0) // PART_GROUPS))).cast("int"))
    placed = (best_fit(classes, capacity) if capacity else pack_near_equal(classes, shards)) if classes else []
    runs: dict[int, list[tuple[int, int]]] = {}
    for size, shard, n in placed:
        done = runs.setdefault(size, [])
        done.append(((done[-1][0] if done else 0) + n, shard))
    spark = docs.sparkSession
    places = spark.createDataFrame(list(runs.items()), "_class long, _runs array<struct<upto: long, shard: int>>")
    within = Window.partitionBy("_class", "_part").orderBy("_key", "text_crc32", "size")
    parts = groups.groupBy("_class", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_class").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    ranked = groups.withColumn("_rank", F.row_number().over(within)).join(parts, ["_class", "_part"]).join(F.broadcast(places), "_class")
    ranked = ranked.withColumn("shard", F.expr("filter(_runs, r -> r.upto >= _before + _rank)[0].shard"))
    homes = materialize(ranked.select(*group, "shard"), "homes")
    placed_rows = rows.join(homes, group)
    # Slots: a hashed chunk of a shard numbers its rows after those of the chunks before it.
    chunks = max(16, math.ceil(sum(r["rows"] for r in counted) / 2_000_000))
    placed_rows = placed_rows.withColumn("_chunk", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(chunks)).cast("int"))
    placed_rows = materialize(placed_rows.select("doc_id", "size", "text_crc32", "shard", "_chunk"), "placed")
    offsets = placed_rows.groupBy("shard", "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    offsets = offsets.select("shard", "_chunk", F.coalesce(F.sum("_n").over(Window.partitionBy("shard").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    slot = F.row_number().over(Window.partitionBy("shard", "_chunk").orderBy("doc_id", "text_crc32"))
    out = placed_rows.withColumn("_row", slot - 1).join(offsets, ["shard", "_chunk"])
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("_base") + F.col("_row")).alias("slot"))
