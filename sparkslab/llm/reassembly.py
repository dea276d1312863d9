"""Conversation turns put back in order from late, repeated and shuffled arrivals, by a stateful stream.

Arrivals come in numbered batches.  A conversation's state is a serialised
min-heap of the kept turns that are not released yet; with the released run,
which is an interval, these are its set of kept turns.  A batch pushes what is
new and pops while the top equals the next turn.  The stream is started anew
for every batch on one checkpoint, and the batch's number is in the closure of
that start: a conversation that times out compares it with the batch in which
it was last heard of.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkslab.plans.stage import new_path

#: Batches, and how many of them without an arrival close a conversation.
BATCHES, QUIET = 12, 2

ARRIVAL = "conv_id long, turn long, first long, role string, payload string"
EVENT = "event string, conv_id long, turn long, batch long, role string, payload string, n_missing long, n_breaks long"
_STATE = "first long, next long, before string, breaks long, seen long, closed boolean, heap string"
_NAMES = [x.split()[0] for x in EVENT.split(", ")]


class Kept:
    """A conversation's kept turns; ``heap`` has (turn, role, payload) of those not released."""

    def __init__(self, first: int, following: int | None = None, before: str | None = None, breaks: int = 0, heap: str = "[]") -> None:
        self.first, self.next, self.before, self.breaks = first, first if following is None else following, before, breaks
        self.heap = [tuple(x) for x in json.loads(heap)]
        self.roles = {turn: role for turn, role, _ in self.heap}
        if self.next > first:
            self.roles[self.next - 1] = before

    def add(self, turn: int, role: str, payload: str) -> None:
        """Keep a turn's earliest arrival; a repeat changes nothing."""
        if turn < self.next or turn in self.roles:
            return
        self.breaks += (self.roles.get(turn - 1) == role) + (self.roles.get(turn + 1) == role)
        self.roles[turn] = role
        heapq.heappush(self.heap, (turn, role, payload))

    def released(self) -> Iterator[tuple[int, str, str]]:
        """Pop the gapless run."""
        while self.heap and self.heap[0][0] == self.next:
            turn, role, payload = heapq.heappop(self.heap)
            self.next, self.before = turn + 1, role
            yield turn, role, payload

    def missing(self) -> int:
        """Turns not kept, from the first to the largest kept."""
        return max(t for t, _, _ in self.heap) - self.next + 1 - len(self.heap) if self.heap else 0

    def waiting(self) -> str:
        """The unreleased turns' numbers, ascending."""
        return ",".join(str(t) for t, _, _ in sorted(self.heap))

    def saved(self) -> tuple:
        """What the state holds of this, but for ``first``."""
        return self.next, self.before, self.breaks, json.dumps(self.heap, separators=(",", ":"))


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_NAMES, dtype=object)


def step(batch: int, last: bool = False):
    """The state function of the start that feeds ``batch``; the last start closes what is open."""

    def run(key: tuple, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        conv = None if key[0] is None or key[0] != key[0] else int(key[0])
        kept, seen = None, batch
        if state.exists:
            first, following, before, breaks, seen, closed, heap = state.get
            if closed:
                for pdf in pdfs:
                    if len(pdf):
                        yield _frame([("reject", conv, int(t), batch, r, p, None, None) for t, r, p in zip(pdf["turn"].tolist(), pdf["role"].tolist(), pdf["payload"].tolist(), strict=True)])
                return
            kept = Kept(first, following, before, breaks, heap)
        for pdf in pdfs if not state.hasTimedOut else ():
            for turn, first, role, payload in zip(pdf["turn"].tolist(), pdf["first"].tolist(), pdf["role"].tolist(), pdf["payload"].tolist(), strict=True):
                kept, seen = kept or Kept(int(first)), batch
                kept.add(int(turn), role, payload)
            out = [("release", conv, *x, None, None) for x in ((t, batch, r, p) for t, r, p in kept.released())] if kept else []
            if out:
                yield _frame(out)
        if kept is None:
            return
        closing = last or batch - seen >= QUIET
        if closing:
            yield _frame([("close", conv, -1, batch, None, kept.waiting(), kept.missing(), kept.breaks)])
            state.update((kept.first, kept.next, None, 0, seen, True, "[]"))
        else:
            following, before, breaks, heap = kept.saved()
            state.update((kept.first, following, before, breaks, seen, False, heap))
            state.setTimeoutDuration(1)  # heard at the next start, unless there are arrivals

    return run


def arrivals(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, first, role, payload, batch): the arrivals of ``conversations`` rows, and one row without a turn for each batch and the end.

    A row arrives in batch h % 12, where h is the first 32 bits of the SHA-256 of
    ``conv_id:turn``; if h % 7 < 2 it arrives once more, as the user's, in batch
    (h + 5) % 12.  Of a turn's arrivals in a batch the one with the least payload
    ``role|text`` counts.  Rows without a turn are left out; null roles and
    texts are empty, a null conv_id is a conversation and the key's empty part.
    The rows without a turn make every batch start, also an empty one.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("turn is not null")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.lit(":"), F.col("turn").cast("string"))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long")
    late = F.when(F.col("h") % 7 < 2, F.array(F.struct((F.col("h") % BATCHES).alias("batch"), F.col("role").alias("role")), F.struct(((F.col("h") + 5) % BATCHES).alias("batch"), F.lit("user").alias("role"))))
    each = F.coalesce(late, F.array(F.struct((F.col("h") % BATCHES).alias("batch"), F.col("role").alias("role"))))
    firsts = rows.groupBy("conv_id").agg(F.min("turn").alias("first")).withColumnRenamed("conv_id", "_conv")
    rows = rows.join(firsts, F.col("conv_id").eqNullSafe(F.col("_conv"))).withColumn("h", h).withColumn("_a", F.explode(each))
    sent = rows.select("conv_id", "turn", "first", "_a.batch", F.struct(F.concat("_a.role", F.lit("|"), "text").alias("payload"), F.col("_a.role").alias("role")).alias("_p"))
    least = sent.groupBy("conv_id", "turn", "first", "batch").agg(F.min("_p").alias("_p")).select("conv_id", "turn", "first", "_p.role", "_p.payload", "batch")
    marks = turns.sparkSession.range(BATCHES + 1).select(*[F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in ARRIVAL.split(", ")], F.col("id").alias("batch"))
    return least.unionByName(marks)


def reassemble(spark: SparkSession, folder: str, at: str, batches: int = BATCHES) -> DataFrame:
    """The events of the arrivals in ``folder``, which has a folder ``batch=k`` of Parquet files for each batch and for the end.

    One start for each on the checkpoint in ``at``, where the events are
    written, too: a start that is lost is repeated from its offsets, and the
    sink's log counts its files once.  A turn arrives at most once in a batch.
    Rows without a turn only make a batch start.

    release: a turn of the gapless run from the conversation's first.  reject:
    an arrival after closing.  close: turn -1, the unreleased turns' numbers as
    payload, n_missing and n_breaks (kept turns whose predecessor is kept and
    has the same role).
    """
    for k in range(batches + 1):
        # a pattern, though of one folder: a plain path would have to be the parent of the earlier starts' files
        rows = spark.readStream.schema(ARRIVAL).parquet(f"{folder}/batch={{{k}}}").where("turn is not null")
        events = rows.groupBy("conv_id").applyInPandasWithState(step(k, k == batches), EVENT, _STATE, "append", "ProcessingTimeTimeout")
        query = events.writeStream.outputMode("append").trigger(once=True).option("checkpointLocation", f"{at}/checkpoint").format("parquet").option("path", f"{at}/events").start()
        query.awaitTermination()
    return spark.read.schema(EVENT).parquet(f"{at}/events")


def reassembled(turns: DataFrame) -> DataFrame:
    """All events of ``conversations`` rows, cut into batches and fed to the stream in new folders."""
    spark = turns.sparkSession
    folder = new_path(spark, "turn-arrivals")
    arrivals(turns).write.partitionBy("batch").option("compression", "zstd").parquet(folder)
    return reassemble(spark, folder, new_path(spark, "turn-stream"))


def digests(events: DataFrame) -> DataFrame:
    """event, conv_id, turn, batch, sha256 of the payload, n_missing and n_breaks."""
    return events.select("event", "conv_id", "turn", "batch", F.sha2("payload", 256).alias("sha256"), "n_missing", "n_breaks")
