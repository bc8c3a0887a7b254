"""Streaming forms of the chunk, phase, metrics and pull-progress operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from paperloom.functions.patterns import FLUSH_MS
from paperloom.operators.monitoring import Flusher

#: How often host metrics are read.
POLL_SECONDS = 3

BATCH = "stream long, batch long, text string, final boolean"
_STATE = "pending string, last_ms double, batch long"


def flush_stream(chunks: DataFrame) -> DataFrame:
    """From a stream of (stream, seq, ms, text, end): batches of text as they fill up or get late.

    State per stream: the pending text, the time of the last flush and the batch number. A chunk
    with end set flushes what is pending and forgets the stream. A stream that falls silent with
    text pending is flushed by a timer of FLUSH_MS.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pending, last, batch = state.get if state.exists else ("", -1.0, 0)
        columns = ["stream", "batch", "text", "final"]
        if state.hasTimedOut:
            state.update(("", last + FLUSH_MS, batch + 1))
            yield pd.DataFrame([(key[0], batch, pending, False)] if pending else [], columns=columns)
            return
        out = []
        rows = pd.concat(list(frames)).sort_values("seq")
        for text, ms, end in zip(rows["text"], rows["ms"], rows["end"], strict=True):
            flusher = Flusher(len(pending), None if last < 0 else last, batch)
            flusher.take(len(text or ""), float(ms))
            pending, last = pending + (text or ""), flusher.last
            if flusher.batch > batch or (end and pending):
                out.append((key[0], batch, pending, bool(end)))
                pending, batch = "", batch + 1
            if end:
                last = -1.0
        if len(rows) and bool(rows["end"].iloc[-1]):
            state.remove()
        else:
            state.update((pending, last, batch))
            if pending:
                state.setTimeoutDuration(FLUSH_MS)
        yield pd.DataFrame(out, columns=columns)

    return chunks.groupBy("stream").applyInPandasWithState(step, BATCH, _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def latest(events: DataFrame, key: str, order: Column, value: Column) -> DataFrame:
    """The newest value per key (a phase, a status, a progress); works on streams in update mode."""
    return events.groupBy(key).agg(F.max_by(value, order).alias("latest"), F.max(order).alias("at"))


def progress(completed: Column, total: Column) -> Column:
    """A download's whole percentage; 0 while the total is unknown."""
    return F.when(F.coalesce(total, F.lit(0)) > 0, F.floor(completed / total * 100 + 0.5)).otherwise(0).cast("long")


def windowed_metrics(samples: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Counts and mean values per type and window of event time, with a bound on lateness."""
    timed = samples.withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))


def sessions(events: DataFrame, key: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """Sessions of a key's events (ts): start, end (the last event and the gap), number of events; a new one begins after a gap without any."""
    timed = events.withWatermark("ts", late)
    found = timed.groupBy(F.session_window("ts", gap).alias("session"), key).agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    return found.select(key, F.col("session.start").alias("start"), F.col("session.end").alias("end"), "last", "n")


def dropped_rows(query: StreamingQuery) -> int:
    """How many rows a query has dropped because they came after the watermark, as far back as its progress reaches."""
    return sum(o["numRowsDroppedByWatermark"] for p in query.recentProgress for o in p["stateOperators"])


def within(left: DataFrame, right: DataFrame, key: str, before: str, late: str = "10 minutes") -> DataFrame:
    """Pairs of rows with the same key where right's ts lies at most `before` ahead of left's: left's columns and right's as right_<name>.

    Both may be streams: the interval and the watermarks bound the state that either side keeps.
    """
    other = right.withWatermark("ts", late).select(*[F.col(c).alias(f"right_{c}") for c in right.columns])
    near = F.col("right_ts").between(F.col("ts") - F.expr(f"INTERVAL {before}"), F.col("ts"))
    return left.withWatermark("ts", late).join(other, (F.col(key) == F.col(f"right_{key}")) & near)


#: What a trigger should be set to for chunk batches.
FLUSH_TRIGGER = f"{FLUSH_MS} milliseconds"


def polled(samples: DataFrame, seconds: int = POLL_SECONDS) -> DataStreamWriter:
    """A writer that takes what has come in every few seconds."""
    return samples.writeStream.trigger(processingTime=f"{seconds} seconds")


class Poll:
    """polled() with a pause. What comes in meanwhile is taken after it goes on: `write` names a checkpoint, which knows how far it got."""

    def __init__(self, samples: DataFrame, write: Callable[[DataStreamWriter], DataStreamWriter], seconds: int = POLL_SECONDS):
        self.samples, self.write, self.seconds, self.query = samples, write, seconds, None

    def resume(self) -> StreamingQuery:
        """Starts, or goes on after a pause; a running poll is left alone."""
        if self.query is None or not self.query.isActive:
            self.query = self.write(polled(self.samples, self.seconds)).start()
        return self.query

    def pause(self) -> None:
        if self.query is not None:
            self.query.stop()


def stop_all(spark: SparkSession) -> int:
    """Stops every streaming query and cancels every running job of the session; how many queries there were."""
    active = spark.streams.active
    for query in active:
        query.stop()
    spark.sparkContext.cancelAllJobs()
    return len(active)


class Lifecycle(StreamingQueryListener):
    """Passes on what happens to queries: started, progress with its number of rows, then complete or error as the last event.

    Register it with spark.streams.addListener(). Events after a query's last one are dropped.
    """

    def __init__(self, tell: Callable[[str, str, str | int | None], None]):
        self.tell, self.open = tell, set()

    def onQueryStarted(self, event) -> None:
        self.open.add(str(event.runId))
        self.tell(str(event.runId), "started", event.name)

    def onQueryProgress(self, event) -> None:
        if str(event.progress.runId) in self.open:
            self.tell(str(event.progress.runId), "progress", event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:
        """Nothing came in: no event."""

    def onQueryTerminated(self, event) -> None:
        if str(event.runId) in self.open:
            self.open.discard(str(event.runId))
            self.tell(str(event.runId), "error" if event.exception else "complete", event.exception)
