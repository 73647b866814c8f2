"""Order MinHash fingerprints (Marçais et al., 2019) with built-in functions only.

The k-mers of a text (``k`` words in a row) are numbered by occurrence, so a repeated k-mer counts
each time.  A signature position is a permutation of the numbered k-mers: its ``l`` least ones are
put in text order and hashed as a tuple.  Moving text changes that order, so signatures follow
edit distance, not only the set of k-mers.

Permutations come as ``RINGS`` independent hashes, each with evenly spaced points from which the
hash values are read in cyclic order (circulant permutations, C-MinHash, Li & Li, 2022).  With 16
points on each of four rings the likeness varies about as with 64 independent hashes, from ten
k-mers on, at a sixteenth of their cost.

Words are runs without white space.  Characters of scripts that set no spaces are words of their
own, and runs of over ``LONG`` characters are cut after vowels and some digits, that is by content,
so that an edit changes few words there as well.

All of it is array expressions: a shuffle is needed for the next document only.  ``_once`` binds an
intermediate array as a column, where a plain expression would be inlined wherever it is read.
Arrays of k-mers are kept free of nullable elements: such longs are sorted as primitives.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RINGS, POINTS, TUPLE, WORDS = 4, 16, 2, 2
POSITIONS = RINGS * POINTS
LONG = 16
#: A packed long holds 38 bits of hash and 26 bits of word position.
PLACE_BITS = 26
PLACE = (1 << PLACE_BITS) - 1
_WHITE = r"[\x20\x09-\x0D]"
#: All these scripts lie above U+0E00; the range in front spares other characters the look-up of their script.
_ALONE = r"[\x{0E00}-\x{10FFFF}&&[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]]"
_RUN = rf"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]{{{LONG + 1}}}"
_CUTS = rf"{_WHITE}+|(?<={_ALONE})(?=[^\x20\x09-\x0D])|(?<=[^\x20\x09-\x0D])(?={_ALONE})|(?<=[aeiouAEIOU05])(?<=[^\x20\x09-\x0D]{{{LONG}}})(?=[^\x20\x09-\x0D])"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _upto(n: Column) -> Column:
    """0 .. n - 1 as longs; empty for n = 0."""
    return F.slice(F.sequence(F.lit(0).cast("long"), F.greatest(n.cast("long") - 1, F.lit(0).cast("long"))), F.lit(1), n.cast("int"))


def _at(a: Column, i: Column) -> Column:
    return F.get(a, i.cast("int"))


def _hash_of(v: Column) -> Column:
    return F.shiftright(v, PLACE_BITS)


def _packed(h: Column, place: Column) -> Column:
    return h.bitwiseAND(F.lit(~PLACE)).bitwiseOR(place)


def _numbered(kmers: Column) -> Column:
    """Sorted packed k-mers to packed occurrence-numbered ones; only repeats of a k-mer are counted, all others are number 0."""

    def again(v: Column, i: Column) -> Column:
        return (i > 0) & (_hash_of(v) == _hash_of(_at(kmers, i - 1)))

    def first(found: Column) -> Column:
        return F.transform(found, lambda v: _packed(F.xxhash64(_hash_of(v), F.lit(0).cast("long")), v.bitwiseAND(F.lit(PLACE))))

    def number(repeated: Column) -> Column:
        def runs(starts: Column) -> Column:
            def run(start: Column, r: Column) -> Column:
                end = F.coalesce(_at(starts, r + 1), F.size(repeated).cast("long"))
                one = lambda o: _packed(F.xxhash64(_hash_of(_at(repeated, start + o)), o + 1), F.coalesce(_at(repeated, start + o), F.lit(0).cast("long")).bitwiseAND(F.lit(PLACE)))
                return F.transform(_upto(end - start), one)

            return F.flatten(F.transform(starts, run))

        starts = F.filter(_upto(F.size(repeated)), lambda j: (j == 0) | (_hash_of(_at(repeated, j)) != _hash_of(_at(repeated, j - 1))))
        return F.when(F.size(repeated) == 0, first(kmers)).otherwise(F.concat(first(F.filter(kmers, lambda v, i: ~again(v, i))), let(starts, runs)))

    return let(F.filter(kmers, again), number)


def _words(text: Column) -> Column:
    split = F.when(text.rlike(_RUN) | text.rlike(_ALONE), F.split(text, _CUTS)).otherwise(F.split(text, rf"{_WHITE}+"))
    return F.array_remove(split, "")


def _kmers(w: Column, words: int) -> Column:
    """Packed k-mers sorted by hash; a text of fewer words is one."""
    count = F.when(F.size(w) > 0, F.greatest(F.lit(1), F.size(w) - (words - 1))).otherwise(0)
    one = lambda a, i: _packed(F.xxhash64(a, *[_at(w, i + k) for k in range(1, words)]), F.least(i.cast("long"), F.lit(PLACE - 1).cast("long")))
    return F.sort_array(F.transform(F.slice(w, F.lit(1), count), one))


#: The hash bits that stay below the place when a packed k-mer is turned around.
_LOW = (1 << (63 - PLACE_BITS)) - 1


def _turned(v: Column) -> Column:
    """A packed k-mer with its place above its hash, so that k-mers sort by place."""
    return F.shiftleft(v.bitwiseAND(F.lit(PLACE)), 63 - PLACE_BITS).bitwiseOR(_hash_of(v).bitwiseAND(F.lit(_LOW)))


def _point(j: int, points: int) -> int:
    """Where the j-th reading of a ring starts: behind all hashes up to there."""
    p = ((j << 64) // points - (1 << 63)) & ~PLACE | PLACE
    return p if p < 1 << 63 else p - (1 << 64)


def _ring(numbered: Column, number: int) -> Column:
    """One ring: numbered k-mers with hashes of its own, in order."""
    return F.sort_array(F.transform(numbered, lambda v: _packed(F.xxhash64(_hash_of(v), F.lit(number)), v.bitwiseAND(F.lit(PLACE)))))


def _with_points(ring: Column, points: int) -> Column:
    return F.sort_array(F.concat(ring, F.array(*[F.lit(_point(j, points)).cast("long") for j in range(points)])))


def _found(marked: Column, points: int) -> Column:
    """Where each point's first k-mer stands on a ring, from 0: behind as many points and all k-mers below it."""
    return F.array(*[F.array_position(marked, F.lit(_point(j, points)).cast("long")) - (1 + j) for j in range(points)])


def _readings(ring: Column, found: Column, take: int) -> Column:
    """The tuples of a ring's permutations: from each point on the next ``take`` k-mers, in text order, as 16 bits."""

    def one(t: Column) -> Column:
        members = [_at(ring, F.pmod(t + o, F.size(ring))) for o in range(take)]
        if take == 2:
            early, late = F.least(*map(_turned, members)), F.greatest(*map(_turned, members))
            return F.xxhash64(early.bitwiseAND(F.lit(_LOW)), late.bitwiseAND(F.lit(_LOW))).bitwiseAND(F.lit(0xFFFF)).cast("int")
        ordered = F.array_sort(F.transform(F.array(*members), _turned))
        return F.xxhash64(F.transform(ordered, lambda v: v.bitwiseAND(F.lit(_LOW)))).bitwiseAND(F.lit(0xFFFF)).cast("int")

    return F.transform(found, one)


def with_signature(df: DataFrame, text: str, name: str, rings: int = RINGS, points: int = POINTS, take: int = TUPLE, words: int = WORDS) -> DataFrame:
    """``df`` with the signatures of its texts: ``rings`` x ``points`` 16-bit integers; empty for a text without words."""
    keep = [F.col(f"`{c}`") for c in df.columns]
    step = _once(df, "_w", _words(F.col(f"`{text}`")))
    step = _once(step.select(*keep, _kmers(F.col("_w"), words).alias("_k")), "_n", _numbered(F.col("_k"))).select(*keep, "_n")
    step = _once(step, "_r", F.array(*[_ring(F.col("_n"), r) for r in range(rings)])).select(*keep, "_r")
    # Bound as columns, ring by ring, the look-ups of the points are generated code that the JVM
    # compiles: inside a lambda they would be interpreted, and all in one the method would be too large.
    for r in range(rings):
        step = _once(step, "_m", _with_points(F.get("_r", F.lit(r)), points))
        step = _once(step, f"_f{r}", _found(F.col("_m"), points)).drop("_m")
    read = F.concat(*[_readings(F.get("_r", F.lit(r)), F.col(f"_f{r}"), take) for r in range(rings)])
    return step.select(*keep, F.when(F.size(F.get("_r", F.lit(0))) > 0, read).otherwise(F.array().cast("array<int>")).alias(name))


def fingerprint(sig: Column) -> Column:
    """A signature as text: four hex digits a position."""
    return F.array_join(F.transform(sig, lambda v: F.lpad(F.hex(v), 4, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """The share of equal positions; two empty signatures are alike, an empty and another one are not."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), lambda e: e))
    return F.when(F.size(a) == 0, (F.size(b) == 0).cast("double")).otherwise(same / F.greatest(F.size(a), F.size(b)))


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``value`` as a column that later steps read and never compute again."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def with_next(docs: DataFrame, order: str, columns: list[str], tie: str, keys: DataFrame | None = None, buckets: int | None = None) -> DataFrame:
    """Each row with ``columns`` of the next row by ``order`` as ``next_<column>``; the last one meets the first.

    Rows are dealt to ranges of ``order`` whose bounds Spark's range partitioning finds.  The first
    row of each range is sent to the range before as well, so each range finds all its next rows
    by itself: one shuffle, and no task sees more than its range.  Nulls come first.  ``keys``
    has the same ``order`` values where ``docs`` is costly to make; the ranges are found in it.
    """
    keys = docs.select(order) if keys is None else keys
    spark = docs.sparkSession
    buckets = buckets or 4 * max(2, docs.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt_keys = keys.where(F.col(order).isNotNull()).repartitionByRange(buckets, order).groupBy(F.spark_partition_id().alias("p")).agg(F.min(order).alias("least"))
    bounds = sorted(r["least"] for r in dealt_keys.collect())[1:]  # one row for each range
    table = spark.createDataFrame([(bounds,)], "_bounds array<long>")
    steps = max(1, math.ceil(math.log2(len(bounds) + 1)))

    def range_of(df: DataFrame) -> DataFrame:
        """``df`` with the range of each row, by halving: the bounds travel as one row."""

        def halve(s: Column, _: Column) -> Column:
            middle = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
            above = F.get(F.col("_bounds"), middle) <= F.col(order)
            open_ = s["lo"] < s["hi"]
            return F.struct(F.when(open_ & above, middle + 1).otherwise(s["lo"]).alias("lo"), F.when(open_ & ~above, middle).otherwise(s["hi"]).alias("hi"))

        start = F.struct(F.lit(0).alias("lo"), F.size("_bounds").alias("hi"))
        found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda s: s["lo"])
        return df.crossJoin(F.broadcast(table)).withColumn("_range", F.when(F.col(order).isNull(), 0).otherwise(found)).drop("_bounds")

    placed = range_of(docs)
    firsts = range_of(keys).groupBy("_range").agg(F.max(F.col(order).isNull()).alias("null"), F.min(order).alias("least")).orderBy("_range").collect()
    # One row for each range at most: the order value that opens a range, and the range before it.
    ghosts = [(None if r["null"] else r["least"], firsts[i - 1]["_range"]) for i, r in enumerate(firsts)]
    small = F.broadcast(spark.createDataFrame(ghosts, "_least long, _before int"))
    placed = placed.join(small, F.col(order).eqNullSafe(F.col("_least")), "left")
    dealt = placed.select(*docs.columns, F.explode(F.when(F.col("_before").isNull(), F.array(F.struct(F.col("_range").alias("r"), F.lit(0).alias("g")))).otherwise(F.array(F.struct(F.col("_range").alias("r"), F.lit(0).alias("g")), F.struct(F.col("_before").alias("r"), F.lit(1).alias("g"))))).alias("_to"))
    dealt = dealt.select(*docs.columns, F.col("_to.r").alias("_range"), F.col("_to.g").alias("_ghost"))
    by = Window.partitionBy("_range").orderBy("_ghost", F.col(order).asc_nulls_first(), tie)
    ahead = dealt.withColumns({f"next_{c}": F.lead(c).over(by) for c in columns})
    return ahead.where("_ghost = 0").drop("_range", "_ghost")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rings: int = RINGS, points: int = POINTS, take: int = TUPLE, words: int = WORDS) -> DataFrame:
    """Each text's fingerprint: doc_id, fingerprint (hex), signature.

    Null and empty texts, and those of white space only, have an empty fingerprint.  A text of
    fewer words than ``words`` is one k-mer.  Positions beyond 67 million words count as the last
    one.  One row for each input row, repeated and null doc_ids included; equal texts have equal
    fingerprints; an empty table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"))
    rows = with_signature(rows, "_text", "signature", rings, points, take, words)
    return rows.select("doc_id", fingerprint(F.col("signature")).alias("fingerprint"), "signature")


def edited_likeness(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edit, and how like they are.

    The edit replaces the last quarter of the code points by as many from the start of the next
    document's text.  Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next.  Rows of equal doc_id follow each other in the order of their texts,
    null ids first.  Null texts count as empty; an empty table gives no rows; one document is its
    own next one.
    """
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    rows = with_signature(rows, "text", "sig")
    rows = with_next(rows, "doc_id", ["text", "sig"], "text", docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id")))
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long"))
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - quarter), F.substring(F.col("next_text"), F.lit(1), quarter))
    rows = _once(rows, "edited", edited).drop("text", "next_text")
    rows = with_signature(rows, "edited", "edited_sig")
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        fingerprint(F.col("sig")).alias("fingerprint"),
        fingerprint(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"),
        likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
    )
