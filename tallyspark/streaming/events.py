"""Event logs as streams: windows with a watermark, sessions, first deliveries, and a guarded state per key.

Every function takes a batch or a streaming frame of (event_id, ts, user_id, event_type, value). On a
batch the watermark has no effect, so that a batch run gives the result the stream converges to.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.operators.ranged import numbered

EVENTS = T.StructType([T.StructField(n, t) for n, t in (("event_id", T.LongType()), ("ts", T.TimestampType()), ("user_id", T.LongType()), ("event_type", T.StringType()), ("value", T.DoubleType()), ("props", T.StringType()))])
LATE = "10 minutes"

# States of a job and the states that may follow.
FIRST = "queued"
NEXT: dict[str, tuple[str, ...]] = {"queued": ("running",), "running": ("completed", "needs_review", "failed"), "completed": (), "needs_review": (), "failed": ()}


def read_events(spark: SparkSession, folder: str, files_a_trigger: int = 1) -> DataFrame:
    """A folder of event files as a stream."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_a_trigger).parquet(folder)


def tumbling(events: DataFrame, length: str = "1 hour") -> DataFrame:
    """(start, event_type, n, total) by window."""
    out = events.withWatermark("ts", LATE).groupBy(F.window("ts", length), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, length: str = "2 hours", step: str = "1 hour") -> DataFrame:
    """(start, n, total) by overlapping windows."""
    out = events.withWatermark("ts", LATE).groupBy(F.window("ts", length, step)).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(user_id, start, finish, n) of runs of events without a longer gap."""
    out = events.withWatermark("ts", LATE).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("finish"), "n")


def first_deliveries(events: DataFrame, key: str) -> DataFrame:
    """One event per key within the watermark; on a batch, one per key."""
    return events.withWatermark("ts", LATE).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])


def tail(events: DataFrame, after: int) -> DataFrame:
    """Events after a resume id."""
    return events.where(F.col("event_id") > after)


def advance(state: str | None, seen: str) -> str | None:
    """The state after an event; an event that may not follow changes nothing."""
    if state is None:
        return seen if seen == FIRST else None
    return seen if seen in NEXT.get(state, ()) else state


def _folded(events: dict[int, str]) -> tuple[str | None, int]:
    """(state, the event that led to it) after all events of a job, in their order."""
    state, at = None, 0
    for seq in sorted(events):
        new = advance(state, events[seq])
        if new != state:
            state, at = new, seq
    return state, at


def _longest_path(state: str) -> int:
    return 1 + max((_longest_path(s) for s in NEXT[state]), default=-1) if NEXT[state] else 0


def job_states(events: DataFrame, idle_ms: int = 86_400_000) -> DataFrame:
    """(job_id, status, seq): the guarded state of each job. ``events`` is (job_id, seq, status), batch or stream, and may have ``ts``.

    On a batch every transition is one join and a minimum by job: the first event after the last one that
    may follow; no task holds a job. A stream keeps the events of a job, so that those that come late, in
    whatever batch, give the state that a batch gives; with ``ts`` they are dropped when the watermark is
    ``idle_ms`` past the last of them, without it they are kept. Of events with one number the least status counts.
    """
    if not events.isStreaming:
        once = events.groupBy("job_id", "seq").agg(F.min("status").alias("status"))
        first = once.groupBy("job_id").agg(F.min(F.when(F.col("status") == FIRST, F.col("seq"))).alias("at"))
        now = first.select("job_id", F.when(F.col("at").isNotNull(), FIRST).alias("now"), F.coalesce("at", F.lit(0).cast("bigint")).alias("at"))
        moves = F.create_map(*[x for s, after in NEXT.items() for x in (F.lit(s), F.array(*map(F.lit, after)) if after else F.array().cast("array<string>"))])
        for _ in range(_longest_path(FIRST)):
            later = once.join(now, "job_id").where((F.col("seq") > F.col("at")) & F.array_contains(moves[F.col("now")], F.col("status")))
            step = later.groupBy("job_id").agg(F.min(F.struct("seq", "status")).alias("s"))
            now = now.join(step, "job_id", "left").select("job_id", F.coalesce("s.status", "now").alias("now"), F.coalesce("s.seq", "at").alias("at"))
        return now.select("job_id", F.col("now").alias("status"), F.col("at").alias("seq"))

    timed = "ts" in events.columns

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        if state.hasTimedOut:
            state.remove()
            return
        seqs, statuses = state.get if state.exists else ([], [])
        held = dict(zip(seqs, statuses, strict=True))
        last = state.getCurrentWatermarkMs() if timed else 0
        for pdf in frames:
            last = max(last, int(pdf["ts"].max().timestamp() * 1000)) if timed else 0
            for seq, status in pdf[["seq", "status"]].itertuples(index=False, name=None):
                held[int(seq)] = min(status, held.get(int(seq), status))
        state.update((list(held), list(held.values())))
        if timed:
            state.setTimeoutTimestamp(last + idle_ms)
        yield pd.DataFrame([(key[0], *_folded(held))], columns=["job_id", "status", "seq"])

    stream = events.withWatermark("ts", LATE) if timed else events
    return stream.groupBy("job_id").applyInPandasWithState(step, "job_id BIGINT, status STRING, seq BIGINT", "seqs ARRAY<BIGINT>, statuses ARRAY<STRING>", "update", "EventTimeTimeout" if timed else "NoTimeout")


def sequence(events: DataFrame) -> DataFrame:
    """Events numbered within their user in the order of time, users of any size; on batches."""
    return numbered(events, ["user_id"], ["ts", "event_id"], "seq")
