"""Conversation structure repair by iterative-deepening A*.

Spark finds the faults of all rows, brings each conversation's rows together in order and hands
them to tasks as a stream.  A task keeps one byte for each row of the conversation at hand (role
initial and fault), searches the cheapest edits over these bytes and then walks over the rows once
more to apply them; rows beyond ``SPOOL`` bytes wait in a temporary file of the task.

The search goes depth first, in ASCII order of the edits, below a cost bound that rises to the least
cost that the last round has cut off.  A table holds for each state (row, place in the pattern) a
cost that is proven too low to finish from there, in this round and in all later ones.  The first
path that ends within the bound is thus the cheapest one, and of equal ones the least.

A long conversation is searched in blocks of rows from its end: the costs of what follows a block
are then exact for the four places in the pattern, and end the search of the block as goals do.  So
the work grows with the rows, not with their square.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh_name, lean_worker

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Faults of a row: none, two that ask for deletion, one that costs.
NONE, BLANK, DUPLICATE, CUT, GONE = 0, 1, 2, 3, -1
WHITE = " \t\n\x0b\x0c\r"
#: Places in the pattern (s?(ua)+)?: at its start, behind s, behind u, behind a; and where an initial leads.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
STEP = {(START, "s"): AFTER_S, (START, "u"): AFTER_U, (AFTER_S, "u"): AFTER_U, (AFTER_U, "a"): AFTER_A, (AFTER_A, "u"): AFTER_U}
#: The role that is due at each place, and what is still to insert when no row is left.
DUE = ("user", "user", "assistant", "user")
TAILS = ("", "II", "I", "")
ENDS = (0, 2 * INSERT, INSERT, 0)
LEGAL = frozenset(("su", "ua", "au"))
INITIALS = "sua"
#: Rows of a block of the search; bytes of a conversation's rows in memory; conversations and bytes in a batch of results.
BLOCK = 64
SPOOL = 8 << 20
BATCH = 2000
BATCH_BYTES = 4 << 20


@lru_cache(maxsize=200_000)
def search(rows: bytes, start: int, after: tuple[int, int, int, int]) -> tuple[int, str, int]:
    """The cheapest edits of ``rows`` from a place in the pattern: cost with what follows, edits, last place.

    A row is a byte: index of its initial in "sua" or 3, plus 4 times its fault.  ``after`` holds the
    cost of all that follows the rows for each place; no rows are inserted behind the last one.
    """
    n = len(rows)
    faults = [b >> 2 for b in rows]
    initials = [(INITIALS + " ")[b & 3] for b in rows]
    low = [0] * n + [min(after)]
    for i in range(n - 1, -1, -1):  # what each row costs at least
        least = DELETE
        if faults[i] in (NONE, CUT):
            least = min(DELETE, (TRUNCATED if faults[i] == CUT else 0) + (REROLE if initials[i] == " " else KEEP))
        low[i] = low[i + 1] + least
    failed: dict[tuple[int, int], int] = {}
    path: list[str] = []
    last = start

    def descend(i: int, place: int, left: int) -> int:
        """-1 if a path ends within ``left``; else a cost that is needed at least."""
        nonlocal last
        need = failed.get((i, place), low[i])
        if need > left:
            return need
        if i == n:
            if after[place] <= left:
                last = place
                return -1
            failed[i, place] = after[place]
            return after[place]
        due = AFTER_A if place == AFTER_U else AFTER_U
        edits = [("D", DELETE, i + 1, place), ("I", INSERT, i, due)]
        if faults[i] in (NONE, CUT):
            extra = TRUNCATED if faults[i] == CUT else 0
            kept = STEP.get((place, initials[i]))
            if kept is not None:
                edits.append(("K", KEEP + extra, i + 1, kept))
            edits.append(("R", REROLE + extra, i + 1, due))
        least = None
        for letter, cost, j, goal in edits:
            path.append(letter)
            got = descend(j, goal, left - cost)
            if got < 0:
                return -1
            path.pop()
            least = got + cost if least is None else min(least, got + cost)
        failed[i, place] = least
        return least

    bound = low[0]
    while (got := descend(0, start, bound)) >= 0:
        bound = got
    return bound, "".join(path), last


def cheapest_edits(rows: bytes) -> tuple[int, str]:
    """Cost and edits of a whole conversation, block by block from its end."""
    cuts = list(range(0, len(rows), BLOCK))
    after, base, found = ENDS, 0, []
    for a in reversed(cuts):
        block = rows[a : a + BLOCK]
        here = [search(block, place, after) for place in range(4 if a else 1)]
        found.append(here)
        if a:
            least = min(cost for cost, _, _ in here)
            base += least
            after = tuple(cost - least for cost, _, _ in here)
        else:
            base += here[0][0]
    place, out = START, []
    for here in reversed(found):
        _, edits, place = here[place]
        out.append(edits)
    return base, "".join(out) + TAILS[place]


class Spool:
    """Rows of one conversation, those beyond ``SPOOL`` bytes in a temporary file of the task."""

    def __init__(self):
        self.rows, self.size, self.file = [], 0, None

    def add(self, row: tuple) -> None:
        self.rows.append(row)
        self.size += len(row[1]) + len(row[2]) + 64
        if self.size > SPOOL:
            self.file = self.file or tempfile.TemporaryFile()
            pickle.dump(self.rows, self.file)
            self.rows, self.size = [], 0

    def __iter__(self) -> Iterator[tuple]:
        if self.file is not None:
            self.file.seek(0)
            while True:
                try:
                    yield from pickle.load(self.file)
                except EOFError:
                    break
        yield from self.rows

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


class Conversation:
    """What is known of one conversation while its rows pass by."""

    def __init__(self, key):
        self.key, self.classes, self.spool = key, bytearray(), Spool()
        self.turns, self.first, self.last, self.illegal = 0, None, None, 0
        self.faults, self.before = [0, 0, 0, 0], None

    def add(self, turn, role: str, text: str, fault: int) -> None:
        initial = role[:1]
        self.classes.append(max(INITIALS.find(initial), -1) % 4 if initial else 3)
        self.classes[-1] |= fault << 2
        self.faults[fault] += 1
        self.illegal += self.before is not None and self.before + initial not in LEGAL
        self.before = initial
        if turn is not None and turn != self.last:  # in order, so distinct ones follow each other
            self.turns, self.last = self.turns + 1, turn
            self.first = turn if self.first is None else self.first
        self.spool.add((turn, role, text))

    def gaps(self) -> int:
        return self.last - self.first + 1 - self.turns if self.turns else 0

    def repaired(self, edits: str) -> Iterator[tuple]:
        """(edit, turn, role, text) of the repaired rows; deleted ones come without role."""
        rows, place = iter(self.spool), START
        for edit in edits:
            if edit == "I":
                turn, role, text = None, DUE[place], ""
            else:
                turn, role, text = next(rows)
                if edit == "D":
                    yield edit, turn, None, text
                    continue
                role = DUE[place] if edit == "R" else role
            place = STEP[place, role[0]]
            yield edit, turn, role, text


def _stream(batches) -> Iterator[Conversation]:
    """One conversation after the other from rows in order (key, turn, role, text, fault)."""
    now = None
    for batch in batches:
        for key, turn, role, text, fault in zip(*(c.to_pylist() for c in batch.columns)):
            if now is None or key != now.key:
                if now is not None:
                    yield now
                    now.spool.close()
                now = Conversation(key)
            if fault != GONE:
                now.add(turn, role, text, fault)
    if now is not None:
        yield now
        now.spool.close()


def row_faults(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", gone: str | None = None) -> DataFrame:
    """The rows of all conversations together and in order: key, turn, role, text, fault.

    A null role or text is one space.  Rows go by turn (nulls first), equal ones by role and text.
    A row's fault is the first of: blank (no character but ASCII white space), duplicate (an earlier
    row has its role and text), truncated (its last such character is no ``.``, ``!`` or ``?``).
    A row where the column ``gone`` is true only makes its conversation known.  Null keys are one
    conversation.  One shuffle, by key: both sorts stand on it.
    """
    white = F.lit(WHITE)
    there = F.lit(True) if gone is None else ~F.col(gone)
    # White space is trimmed at both ends, so what is left is empty for a blank text only.
    df = rows.select(
        F.col(conv).alias("key"),
        F.col(turn).cast("long").alias("turn"),
        F.when(there, F.coalesce(F.col(role), F.lit(" "))).alias("role"),
        F.when(there, F.coalesce(F.col(text), F.lit(" "))).alias("text"),
    ).repartition("key")
    nth = F.row_number().over(Window.partitionBy("key", "role", "text").orderBy(F.col("turn").asc_nulls_first()))
    last = F.right(F.rtrim("text", white), F.lit(1))
    fault = F.when(F.col("role").isNull(), GONE).when(last == "", BLANK).when(F.col("nth") > 1, DUPLICATE).when(~last.isin(".", "!", "?"), CUT).otherwise(NONE)
    found = df.withColumn("nth", nth).select("key", "turn", "role", "text", fault.alias("fault"))
    return found.sortWithinPartitions("key", F.col("turn").asc_nulls_first(), "role", "text")


def _batches(rows: Iterator[tuple], schema: pa.Schema, size=lambda row: 64) -> Iterator[pa.RecordBatch]:
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += size(row)
        if len(held) >= BATCH or weight >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _arrow_type(df: DataFrame, name: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[name].dataType)


def repair_conversations(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", gone: str | None = None) -> DataFrame:
    """The rows of all conversations after the cheapest edits that make their roles ``(s?(ua)+)?``.

    Kept rows cost 0, a row with a new role (user or assistant) 3, a deleted row 4, an inserted row
    (no text) 3; a truncated row that stays adds 3; blank and duplicate rows are deleted.  Of equally
    cheap edits the ASCII-least in D(elete) < I(nsert) < K(eep) < R(erole) counts.  Initials are case
    sensitive, and an empty role has none that fits.  Columns: the key, place (from 0), edit, turn
    (null if inserted), role, text.  See ``row_faults`` for nulls, ties and repeated rows.  A
    conversation without rows that stay gives none; texts and conversations may have any length: a
    task holds one byte for each row of a conversation and ``SPOOL`` bytes of rows.
    """
    faults = row_faults(rows, conv, turn, role, text, gone)
    key = fresh_name(conv, ["place", "edit", "turn", "role", "text"])
    schema = pa.schema([(key, _arrow_type(faults, "key")), ("place", pa.int64()), ("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])

    def work(batches):
        lean_worker("conversations")

        def out():
            for c in _stream(batches):
                place = 0
                for edit, at, who, body in c.repaired(cheapest_edits(bytes(c.classes))[1]):
                    if who is not None:
                        yield c.key, place, edit, at, who, body
                        place += 1

        yield from _batches(out(), schema, lambda r: len(r[5]) + 64)

    kind = faults.schema["key"].dataType.simpleString()
    return faults.mapInArrow(work, f"`{key}` {kind}, place long, edit string, turn long, role string, text string")


def repair_report(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", gone: str | None = None) -> DataFrame:
    """One row for each conversation: its faults, the edits of ``repair_conversations`` and the digest of their result.

    Columns: the key; gaps (turns missing between the least and the greatest, nulls aside); blank,
    duplicate, truncated; illegal (neighbours whose initials are not su, ua or au); cost; audit (the
    edits' initials); repaired_sha256 of the rows left as ``role:text``, joined by newlines.  A
    conversation without rows has zeros, an empty audit and the digest of the empty string.

    The digest runs over a conversation from end to end, so one task streams it, as long as it may be;
    audit is as long as the conversation has rows, and so is all that the task holds besides a spool.
    """
    faults = row_faults(rows, conv, turn, role, text, gone)
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    key = fresh_name(conv, [*names, "audit", "repaired_sha256"])
    schema = pa.schema([(key, _arrow_type(faults, "key")), *((n, pa.int64()) for n in names), ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def work(batches):
        lean_worker("conversations")

        def out():
            for c in _stream(batches):
                cost, audit = cheapest_edits(bytes(c.classes))
                digest, joint = hashlib.sha256(), b""
                for _, _, who, body in c.repaired(audit):
                    if who is not None:
                        digest.update(joint + f"{who}:{body}".encode())
                        joint = b"\n"
                yield c.key, c.gaps(), c.faults[BLANK], c.faults[DUPLICATE], c.faults[CUT], c.illegal, cost, audit, digest.hexdigest()

        yield from _batches(out(), schema, lambda r: len(r[7]) + 64)

    kind = faults.schema["key"].dataType.simpleString()
    counts = "".join(f", {n} long" for n in names)
    return faults.mapInArrow(work, f"`{key}` {kind}{counts}, audit string, repaired_sha256 string")
