"""Stream state over several micro-batches, expiry, timers, and batches that are replayed."""

import datetime
import random
import time

import pandas as pd
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from paperloom.operators import monitoring
from paperloom.streaming import state, streams

CHUNK = "stream long, seq long, ms long, text string, end boolean"
SAMPLE = "host long, sample long, core long, total long, idle long"


@pytest.fixture(autouse=True)
def rocksdb(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    state.use_rocksdb(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def fed(spark, path, rows, schema):
    """Appends rows as one file, which the stream's next micro-batch takes."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))
    time.sleep(0.01)


def source(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def run(writer):
    query = writer.trigger(availableNow=True).start()
    try:
        assert query.awaitTermination(90)
    finally:
        query.stop()


def test_load_over_micro_batches_equals_the_batch_query(spark, tmp_path):
    rng = random.Random(4)
    rows, total = [], {}
    for sample in range(12):
        for host in range(3):
            for core in range(4):
                t, i = total.get((host, core), (0, 0))
                busy, idle = rng.randrange(9), rng.randrange(9)
                total[host, core] = (t + busy + idle, i + idle)
                rows.append((host, sample, core, *total[host, core]))
    want = {(r.host, r.sample): r.load for r in monitoring.cpu_load(spark.createDataFrame(rows, SAMPLE)).collect()}
    for start in range(0, len(rows), 31):  # samples straddle micro-batches
        fed(spark, tmp_path / "in", rows[start : start + 31], SAMPLE)
    run(state.once(state.cpu_load_stream(source(spark, tmp_path / "in", SAMPLE), None), str(tmp_path / "out"), str(tmp_path / "check"), "update"))
    told = state.taken(spark, str(tmp_path / "out"), state.LOAD)
    assert told.select("batch_no").distinct().count() == 5
    last = told.groupBy("host", "sample").agg(F.max_by("load", "batch_no").alias("load")).collect()
    assert {(r.host, r.sample): r.load for r in last} == want


def batch_rule(rows):
    out = {}
    for stream in {r[0] for r in rows}:
        flusher, texts = monitoring.Flusher(), {}
        for _, _, ms, text, _ in sorted(r for r in rows if r[0] == stream):
            own = flusher.take(len(text), ms)
            texts[own] = texts.get(own, "") + text
        out[stream] = [texts[k] for k in sorted(texts) if texts[k]]
    return out


def test_chunks_over_micro_batches_equal_the_batch_rule(spark, tmp_path):
    rng = random.Random(6)
    rows = [(s, i, i * 20, "x" * rng.randrange(500), i == 39) for i in range(40) for s in range(5)]
    for start in range(0, len(rows), 45):
        fed(spark, tmp_path / "in", rows[start : start + 45], CHUNK)
    # Without a timer, so that the rule by the chunks' own times is compared.
    flushed = state.flush_chunks(source(spark, tmp_path / "in", CHUNK), None)
    run(state.once(flushed, str(tmp_path / "out"), str(tmp_path / "check")))
    got = {}
    for r in state.taken(spark, str(tmp_path / "out"), state.BATCH).orderBy("stream", "batch").collect():
        got.setdefault(r.stream, []).append(r.text)
    assert got == batch_rule(rows)


@pytest.mark.parametrize("silent_ms", [state.SILENT_MS, 500])
def test_timers_flush_and_forget_silent_streams(spark, tmp_path, silent_ms):
    fed(spark, tmp_path / "in", [(1, 0, 0, "abc", False), (2, 0, 0, "whole", True)], CHUNK)
    stream = state.flush_chunks(source(spark, tmp_path / "in", CHUNK), silent_ms)
    query = state.once(stream, str(tmp_path / "out"), str(tmp_path / "check")).trigger(processingTime="500 milliseconds").start()
    rows = lambda: sorted((r.stream, r.batch, r.text, r.final) for r in state.taken(spark, str(tmp_path / "out"), state.BATCH).collect())

    def until(want):
        end = time.monotonic() + 60
        while rows() != want and time.monotonic() < end:
            time.sleep(0.3)
        assert rows() == want

    try:
        first = [(1, 0, "abc", False), (2, 0, "whole", True)]
        until(first)  # the timer's text is never lost, however late the timer comes
        if silent_ms == 500:
            batch = query.lastProgress["batchId"]
            while query.lastProgress["batchId"] < batch + 4:
                time.sleep(0.3)
        fed(spark, tmp_path / "in", [(2, 1, 5, "more", False)], CHUNK)
        # An ended stream goes on with its numbers; one that was forgotten starts over.
        until(sorted([*first, (2, 1, "more", True) if silent_ms > 500 else (2, 0, "more", False)]))
        assert query.exception() is None
    finally:
        query.stop()
        query.awaitTermination(30)


def test_a_replayed_batch_writes_nothing_twice(spark, tmp_path):
    schema = "id long, text string"
    for k in range(3):
        fed(spark, tmp_path / "in", [(k, "a"), (k + 10, "b")], schema)
    start = lambda: run(state.once(source(spark, tmp_path / "in", schema), str(tmp_path / "out"), str(tmp_path / "check")))
    start()
    rows = lambda: sorted((r.id, r.text, r.batch_no) for r in state.taken(spark, str(tmp_path / "out"), schema).collect())
    want = rows()
    assert len(want) == 6
    # The last batch was written, but its commit is lost: it runs again.
    lost = sorted((tmp_path / "check" / "commits").glob("[0-9]*"))[-1]
    lost.unlink()
    (tmp_path / "check" / "commits" / f".{lost.name}.crc").unlink(missing_ok=True)
    fed(spark, tmp_path / "in", [(99, "c")], schema)
    start()
    assert rows() == sorted([*want, (99, "c", 3)])
    # A write that hasn't come to its end isn't read.
    folder = next((tmp_path / "out").glob("query_id=*/batch_no=3"))
    (folder / "_SUCCESS").unlink()
    assert rows() == want


EVENT = "user_id long, ts timestamp, n long"


def test_late_rows_of_sessions_are_dropped_and_counted(spark, tmp_path):
    at = lambda minute: datetime.datetime(2024, 1, 1, 10) + datetime.timedelta(minutes=minute)
    for rows in ([(1, at(0), 0), (1, at(3), 0), (2, at(1), 0)], [(1, at(60), 0)], [(1, at(61), 0)], [(2, at(2), 0), (2, at(55), 0)], [(1, at(200), 0)]):
        fed(spark, tmp_path / "in", rows, EVENT)
    stream = streams.sessions(source(spark, tmp_path / "in", EVENT), "user_id", "5 minutes", "10 minutes")
    writer = state.once(stream, str(tmp_path / "out"), str(tmp_path / "check"))
    query = writer.trigger(availableNow=True).start()
    assert query.awaitTermination(90)
    # The row at minute 2 came when the watermark of the batch before stood at 50; that at minute 55 was in time.
    assert streams.dropped_rows(query) == 1
    got = state.taken(spark, str(tmp_path / "out"), "user_id long, start timestamp, end timestamp, last timestamp, n long").collect()
    assert sorted((r.user_id, r.start, r.n) for r in got) == [(1, at(0), 2), (1, at(60), 2), (2, at(1), 1), (2, at(55), 1)]


def test_interval_join_of_streams_equals_the_batch_form(spark, tmp_path):
    rng = random.Random(2)
    at = lambda: datetime.datetime(2024, 1, 1, 10) + datetime.timedelta(minutes=rng.randrange(300))
    left, right = ([(rng.randrange(4), at(), k) for k in range(60)] for _ in range(2))
    for name, rows in (("left", left), ("right", right)):
        for k in range(0, 60, 20):
            fed(spark, tmp_path / name, sorted(rows, key=lambda r: r[1])[k : k + 20], EVENT)
    pairs = lambda df: sorted((r.n, r.right_n) for r in df.collect())
    batch = streams.within(*(spark.createDataFrame(rows, EVENT) for rows in (left, right)), "user_id", "30 MINUTES")
    stream = streams.within(source(spark, tmp_path / "left", EVENT), source(spark, tmp_path / "right", EVENT), "user_id", "30 MINUTES", "2 hours")
    run(state.once(stream.select("n", "right_n"), str(tmp_path / "out"), str(tmp_path / "check")))
    assert pairs(state.taken(spark, str(tmp_path / "out"), "n long, right_n long")) == pairs(batch)
    assert len(pairs(batch)) == sum(a[0] == b[0] and datetime.timedelta(0) <= a[1] - b[1] <= datetime.timedelta(minutes=30) for a in left for b in right)


def test_a_paused_poll_goes_on_where_it_stopped(spark, tmp_path):
    schema = "id long"
    fed(spark, tmp_path / "in", [(1,)], schema)
    take = state.take_once(str(tmp_path / "out"))
    poll = streams.Poll(source(spark, tmp_path / "in", schema), lambda w: w.foreachBatch(take).option("checkpointLocation", str(tmp_path / "check")), 1)
    ids = lambda: sorted(r.id for r in state.taken(spark, str(tmp_path / "out"), schema).collect())

    def until(want):
        end = time.monotonic() + 60
        while ids() != want and time.monotonic() < end:
            time.sleep(0.3)
        assert ids() == want

    try:
        assert poll.resume() is poll.resume()
        until([1])
        poll.pause()
        poll.pause()
        fed(spark, tmp_path / "in", [(2,)], schema)
        time.sleep(2)
        assert ids() == [1]
        poll.resume()
        until([1, 2])
    finally:
        poll.pause()


class CountedState:
    """A value, list or map state in memory that counts its calls."""

    def __init__(self, calls):
        self.calls, self.held = calls, None

    def __getattr__(self, name):
        def call(*given):
            self.calls.append(name)
            return getattr(self, f"_{name}")(*given)

        return call

    def _exists(self):
        return self.held is not None

    def _get(self):
        return self.held

    def _update(self, value):
        self.held = value

    def _clear(self):
        self.held = None

    def _appendList(self, values):
        self.held = [*(self.held or []), *values]

    def _getValue(self, key):
        return (self.held or {}).get(key)

    def _updateValue(self, key, value):
        self.held = {**(self.held or {}), key: value}


class CountedHandle:
    def __init__(self):
        self.calls = []
        self.getValueState = self.getListState = self.getMapState = lambda *_: CountedState(self.calls)


def test_calls_to_a_streams_state_do_not_grow_with_its_chunks():
    processor, handle = state.FlushProcessor(None), CountedHandle()
    processor.init(handle)
    rows = [Row(stream=7, seq=i, ms=i, text="x" * 100, end=False) for i in range(205)]
    first = list(processor.handleInputRows((7,), iter(rows[104::-1]), None))
    second = list(processor.handleInputRows((7,), iter(rows[105:]), None))
    flusher, want = monitoring.Flusher(), {}
    for r in rows:
        own = flusher.take(100, r.ms)
        want[own] = want.get(own, "") + r.text
    want.pop(flusher.batch, None)  # not closed
    assert {r.batch: r.text for r in first + second} == want
    assert len(handle.calls) <= 12


def test_calls_to_a_hosts_state_do_not_grow_with_its_samples():
    processor, handle = state.LoadProcessor(None), CountedHandle()
    processor.init(handle)
    samples = pd.DataFrame([(1, s, c, 30 * s, 10 * s) for s in range(100) for c in range(4)], columns=["host", "sample", "core", "total", "idle"])
    (first,) = processor.handleInputRows((1,), iter([samples[:202]]), None)
    (second,) = processor.handleInputRows((1,), iter([samples[198:]]), None)
    assert first["load"].tolist() == [0] + [67] * 50 and second["sample"].tolist() == list(range(50, 100)) and set(second["load"]) == {67}
    assert len(handle.calls) <= 24
