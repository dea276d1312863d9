"""Conversation structure repair at least cost, by layers of bitsets.

A repaired conversation's role initials read ``(s?(ua)+)?``.  For each turn,
from the end, one word holds for each cost a set of the grammar's four states:
those from which the rest can be accepted at that cost.  A word's layers are
four bits each, so an edit's price is a shift.  The first layer that holds the
start gives the cost; a walk forward over the words' bits, which takes the
ASCII-least edit that stays on a cheapest way, gives the audit.

Any state is at most seven dearer than the cheapest of its turn (two inserts
lead from any state to any that can still be reached, and a kept ``s`` can be
deleted instead), so a word needs no more than LAYERS layers above its own
cheapest: work is in proportion to the turns.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
LAYERS = 12

_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_ALL = (1 << 4 * LAYERS) - 1
_EACH = [sum(1 << 4 * k + state for k in range(LAYERS)) for state in range(4)]
#: The state after a user's or an assistant's turn from each state, and what that turn is.
_NEXT = (_USER, _USER, _ASSISTANT, _USER)
_ROLE = ("user", "user", "assistant", "user")
#: The state after a kept turn, by state and initial.
_KEPT = {(_START, "s"): _SYSTEM, (_START, "u"): _USER, (_SYSTEM, "u"): _USER, (_USER, "a"): _ASSISTANT, (_ASSISTANT, "u"): _USER}

#: Faults of a turn.
FINE, BLANK, DUPLICATE, CUT = range(4)


def _before(word: int, initial: str) -> int:
    """The states, in each layer, from which a turn with this initial leads into ``word``."""
    if initial == "u":
        user = word & _EACH[_USER]
        return user >> 2 | user >> 1 | user << 1
    if initial == "a":
        return (word & _EACH[_ASSISTANT]) >> 1
    return (word & _EACH[_SYSTEM]) >> 1 if initial == "s" else 0


def _inserted(word: int) -> int:
    """With what up to two inserts lead into it; more never pay."""
    for _ in range(2):
        word |= (_before(word, "u") | _before(word, "a")) << 4 * INSERT
    return word


def least_edits(initials: str, faults: bytes) -> tuple[int, str]:
    """Cost and audit of the cheapest repair of turns by their roles' initials (a space for none) and faults."""
    n = len(faults)
    words, bases = array("Q", bytes(8 * (n + 1))), array("q", bytes(8 * (n + 1)))
    word, base = _inserted(1 << _START | 1 << _ASSISTANT) & _ALL, 0
    words[n] = word
    for i in range(n - 1, -1, -1):
        if faults[i] in (BLANK, DUPLICATE):
            base += DELETE
        else:
            # what every edit of the turn costs at least is in the base, the rest in the layers
            least = TRUNCATED if faults[i] == CUT else 0
            either = _before(word, "u") | _before(word, "a")
            word = _inserted(_before(word, initials[i]) | either << 4 * REROLE | word << 4 * (DELETE - least))
            low = ((word & -word).bit_length() - 1) // 4
            word = word >> 4 * low & _ALL
            base += least + low
        words[i], bases[i] = word, base
    left = next(base + k for k in range(LAYERS) if word >> 4 * k + _START & 1)
    cost, audit, i, state = left, [], 0, _START

    def open_at(turn: int, at: int, rest: int) -> bool:
        k = rest - bases[turn]
        return 0 <= k < LAYERS and bool(words[turn] >> 4 * k + at & 1)

    while i < n or left:
        more = TRUNCATED if i < n and faults[i] == CUT else 0
        bound = i < n and faults[i] in (BLANK, DUPLICATE)
        kept = None if i == n or bound else _KEPT.get((state, initials[i]))
        if i < n and open_at(i + 1, state, left - DELETE):
            edit, i, left = "D", i + 1, left - DELETE
        elif open_at(i, _NEXT[state], left - INSERT):
            edit, state, left = "I", _NEXT[state], left - INSERT
        elif kept is not None and open_at(i + 1, kept, left - more):
            edit, i, state, left = "K", i + 1, kept, left - more
        else:
            edit, i, state, left = "R", i + 1, _NEXT[state], left - REROLE - more
        audit.append(edit)
    return cost, "".join(audit)


#: What ``repair`` returns: a row for each edit, then one without edit for the conversation.
EDITS = "conv_id long, place long, edit string, turn long, role string, text string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
_FIELDS = [f.split() for f in EDITS.split(", ")]
_SCHEMA = pa.schema([(n, pa.int64() if t == "long" else pa.string()) for n, t in _FIELDS])
#: Edits of a batch that goes back to the JVM, in rows and characters.
_BATCH_ROWS, _BATCH_CHARS = 4096, 4_000_000


class _Conversation:
    """What is known of the conversation that streams by: first all faults, then all texts."""

    def __init__(self, conv: int | None) -> None:
        self.conv, self.initials, self.faults, self.seen = conv, [], bytearray(), set()
        self.least = self.most = None
        self.distinct = self.illegal = self.at = 0
        self.state, self.audit, self.cost = _START, None, 0

    def look(self, turn: int | None, initial: str, digest: bytes, fault: int) -> None:
        """Take in a turn's fault; a turn with role and text seen before is a duplicate unless blank."""
        if fault != BLANK:
            fault = DUPLICATE if digest in self.seen else fault
            self.seen.add(digest)
        if self.initials and self.initials[-1] + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.initials.append(initial)
        self.faults.append(fault)
        if turn is not None:
            self.distinct += turn != self.most
            self.least, self.most = turn if self.least is None else self.least, turn

    def settle(self) -> None:
        """All faults are known."""
        if self.audit is None:
            self.seen = set()
            self.cost, self.audit = least_edits("".join(x or " " for x in self.initials), bytes(self.faults))

    def _row(self, edit: str, turn: int | None, role: str | None, text: str | None) -> tuple:
        self.at += 1
        return (self.conv, self.at - 1, edit, turn, role, text, None, None, None, None, None, None)

    def inserts(self) -> Iterator[tuple]:
        """The edits before the next turn."""
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            role, self.state = _ROLE[self.state], _NEXT[self.state]
            yield self._row("I", None, role, "")

    def edit(self, turn: int | None, role: str, text: str) -> Iterator[tuple]:
        """The edits before a turn, and its own."""
        yield from self.inserts()
        edit = self.audit[self.at]
        if edit == "R":
            role, self.state = _ROLE[self.state], _NEXT[self.state]
        elif edit == "K":
            self.state = _KEPT[self.state, role[:1]]
        yield self._row(edit, turn, role, text)

    def end(self) -> Iterator[tuple]:
        """What is inserted at the end, and the conversation's counts."""
        self.settle()
        yield from self.inserts()
        gaps = self.most - self.least + 1 - self.distinct if self.most is not None else 0
        yield (self.conv, None, None, None, None, None, gaps, *(self.faults.count(f) for f in (BLANK, DUPLICATE, CUT)), self.illegal, self.cost)


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of whole conversations in order: conv_id, dropped, pass, turn, role, digest, fault, text (in the second pass)."""
    now, out, chars = None, [], 0

    def packed() -> pa.RecordBatch:
        nonlocal out, chars
        made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)
        out, chars = [], 0
        return made

    for batch in batches:
        for conv, dropped, second, turn, role, digest, fault, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is None or now.conv != conv:
                if now is not None:
                    out.extend(now.end())
                now = _Conversation(conv)
            if dropped:
                continue
            if not second:
                now.look(turn, role[:1], digest, fault)
                continue
            now.settle()
            out.extend(now.edit(turn, role, text))
            chars += len(text)
            if len(out) >= _BATCH_ROWS or chars >= _BATCH_CHARS:
                yield packed()
    if now is not None:
        out.extend(now.end())
    if out:
        yield packed()


def repair(turns: DataFrame) -> DataFrame:
    """The edits that repair each conversation of ``turns`` (conv_id, turn, role, text), in order, then one row with its counts.

    Of a deleted turn, role and text are what they were.  Turns go by number,
    nulls first; those with one number by role, then by a digest of the text.
    A null conv_id is a conversation; null roles and texts are one space.  A
    row of which a column ``dropped`` is true only says that there is such a
    conversation.  ``text`` of white space only is blank, a role and text seen
    before is a duplicate, a text that doesn't end with one of ``.!?`` (white
    space aside) is truncated; the first of these counts.

    A conversation's rows go to one task, sorted by Spark, and stream through it
    twice: without texts, of which it keeps about a hundred bytes a turn, then
    with texts, of which it keeps none.  Conversations follow each other, and
    their edits, in the order of the partitions' rows.
    """
    dropped = F.coalesce(F.col("dropped").cast("boolean"), F.lit(False)) if "dropped" in turns.columns else F.lit(False)
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), dropped.alias("dropped"), F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"))
    last = F.substring(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), -1, 1)
    fault = F.when(last == "", BLANK).when(~last.isin(".", "!", "?"), CUT).otherwise(FINE)
    rows = rows.withColumn("digest", F.unhex(F.sha2(F.concat("role", F.lit("\0"), "text"), 256))).withColumn("fault", fault.cast("int"))
    rows = rows.withColumn("second", F.explode(F.when(F.col("dropped"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))))
    rows = rows.select("conv_id", "dropped", "second", "turn", "role", "digest", "fault", F.when(F.col("second"), F.col("text")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "second", F.col("turn").asc_nulls_first(), "role", "digest")
    return rows.mapInArrow(_edits, EDITS)


def damaged(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, role, text) with the faults of a hash of ``conv_id:turn``, and dropped.

    By the CRC-32 modulo 20: 0 is dropped, 1 loses its text, 2 its ``.!?``, 3
    stands twice, 4 is the user's.  Nulls are one space there and in role and text.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("_kind"))
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.withColumn("text", text).withColumn("role", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")))
    twice = F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.withColumn("_copy", twice).select("conv_id", "turn", "role", "text", (F.col("_kind") == 0).alias("dropped"))


_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
REPORT = "conv_id long, " + ", ".join(f"{c} long" for c in _COUNTS) + ", audit string, repaired_sha256 string"


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    audit, digest, joint = [], hashlib.sha256(), b""
    for batch in batches:
        done = []
        for row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "edit", "role", "text", *_COUNTS)), strict=True):
            conv, edit, role, text, *counts = row
            if edit is None:
                done.append((conv, *counts, "".join(audit), digest.hexdigest()))
                audit, digest, joint = [], hashlib.sha256(), b""
                continue
            audit.append(edit)
            if edit != "D":
                digest.update(joint + f"{role}:{text}".encode())
                joint = b"\n"
        if done:
            types = [pa.int64()] * (len(_COUNTS) + 1) + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names=[x.split()[0] for x in REPORT.split(", ")])


def reports(edits: DataFrame) -> DataFrame:
    """A row for each conversation of ``repair``: its counts, the audit, and the SHA-256 of the repaired turns ``role:text``, joined by newlines.

    ``edits`` must come straight from ``repair``: its order is relied on, and nothing is shuffled.
    """
    return edits.select("conv_id", "edit", "role", "text", *_COUNTS).mapInArrow(_digested, REPORT)
