"""Queries over logs, metrics, chunk streams and message catalogues."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from paperloom.functions import dates
from paperloom.operators import asof, catalogues, monitoring
from paperloom.streaming import state, streams

from .base import literal_rows, scratch, table, values_sql

_CAP = 3_000


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.select("event_id", "ts", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.length("props").alias("size"), "event_type", "props")


def log_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _lines(spark, sf_dir).groupBy(F.col("day").alias("name")).agg(F.max("ts").alias("mtime"), F.count("*").alias("lines"))
    return monitoring.kept_files(files).select("name", "lines")


RETENTION_SQL = "SELECT name, lines FROM (SELECT strftime(ts, '%Y-%m-%d') AS name, max(ts) AS mtime, count(*) AS lines FROM events GROUP BY 1) ORDER BY mtime DESC, name LIMIT 14"


def log_size_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = monitoring.capped(_lines(spark, sf_dir), "day", ["ts", "event_id"], F.col("size"), _CAP, scratch(spark, "capped"))
    return kept.groupBy("day").agg(F.count("*").alias("lines"), F.sum("size").alias("bytes"))


CAP_SQL = f"""
WITH l AS (SELECT strftime(ts, '%Y-%m-%d') AS day, ts, event_id, length(props) AS size FROM events),
n AS (SELECT *, row_number() OVER w AS line_no, sum(size) OVER w - size AS bytes_before FROM l WINDOW w AS (PARTITION BY day ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
c AS (SELECT *, coalesce(max(CASE WHEN line_no % 200 = 0 THEN bytes_before END) OVER (PARTITION BY day ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 0) AS checked FROM n)
SELECT day, count(*) AS lines, sum(size)::BIGINT AS bytes FROM c WHERE checked <= {_CAP} GROUP BY day"""


def log_level_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "view", "info").when(F.col("event_type") == "click", "debug").otherwise(F.col("event_type"))
    ok = monitoring.valid_entry(F.col("level"), F.col("event_type"), F.col("props"))
    return _lines(spark, sf_dir).withColumn("level", level).groupBy("level", ok.alias("accepted")).agg(F.count("*").alias("n"))


LEVEL_SQL = """SELECT level, level IN ('debug', 'info', 'warn', 'error') AS accepted, count(*) AS n
FROM (SELECT CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'info' WHEN 'click' THEN 'debug' ELSE event_type END AS level FROM events) GROUP BY ALL"""


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Four cores of 40 hosts, sampled in turn.
    sample = F.floor(F.col("event_id") / 160)
    idle = sample * 20 + (F.col("event_id") * 31) % 17
    return table(spark, sf_dir, "events").select((F.floor(F.col("event_id") / 4) % 40).alias("host"), sample.alias("sample"), (F.col("event_id") % 4).alias("core"), (idle + sample * 9 + (F.col("event_id") * 17) % 13).alias("total"), idle.alias("idle"))


def cpu_load_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitoring.cpu_load(_samples(spark, sf_dir))


CPU_SQL = """
WITH s AS (SELECT event_id // 4 % 40 AS host, event_id // 160 AS sample, event_id % 4 AS core, (event_id // 160) * 20 + (event_id * 31) % 17 AS idle, (event_id // 160) * 9 + (event_id * 17) % 13 AS busy FROM events),
d AS (SELECT host, sample, idle + busy - lag(idle + busy) OVER w AS d_total, idle - lag(idle) OVER w AS d_idle FROM s WINDOW w AS (PARTITION BY host, core ORDER BY sample))
SELECT host, sample, CASE WHEN sum(d_total) > 0 THEN greatest(0, least(100, floor((sum(d_total) - sum(d_idle))::DOUBLE / sum(d_total)::DOUBLE * 100 + 0.5)))::BIGINT ELSE 0 END AS load FROM d GROUP BY host, sample"""


def active_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = F.when(F.col("event_type").isin("click", "signup"), 1).when(F.col("event_type").isin("error", "purchase"), -1).otherwise(0)
    return monitoring.active_streams(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], step).select("event_id", "active")


#: The floored sum, by the rule itself: a fold over each user's steps.
ACTIVE_SQL = """
WITH e AS (SELECT *, CASE WHEN event_type IN ('click', 'signup') THEN 1 WHEN event_type IN ('error', 'purchase') THEN -1 ELSE 0 END AS step, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
p AS (SELECT *, sum(step) OVER (PARTITION BY user_id ORDER BY rn) AS plain FROM e)
SELECT event_id, (plain - least(0, min(plain) OVER (PARTITION BY user_id ORDER BY rn)))::BIGINT AS active FROM p"""


def active_streams_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One gauge over the streams of all users."""
    step = F.when(F.col("event_type").isin("click", "signup"), 1).when(F.col("event_type").isin("error", "purchase"), -1).otherwise(0)
    events = table(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    return monitoring.active_streams_total(events, ["ts", "event_id"], step, scratch(spark, "gauge")).select("event_id", "active")


ACTIVE_TOTAL_SQL = ACTIVE_SQL.replace("PARTITION BY user_id ", "")


def _arriving(spark: SparkSession, rows: DataFrame, order: str, start: Callable[[DataFrame], DataStreamWriter], parts: int = 4) -> None:
    """Rows come in several parts, in order; after each one the stream goes on from its checkpoint."""
    path = scratch(spark, "stream-in")
    least, most = rows.agg(F.min(order), F.max(order)).first()
    stream = None
    for k in range(parts):
        low, high = (least + (most + 1 - least) * j // parts for j in (k, k + 1))
        rows.where((F.col(order) >= low) & (F.col(order) < high)).write.mode("append").parquet(path)
        stream = stream or spark.readStream.schema(rows.schema).parquet(path)
        start(stream).trigger(availableNow=True).start().awaitTermination()


def cpu_load_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cpu_load_delta as a stream with state per host; the last word on a sample holds."""
    state.use_rocksdb(spark)
    path = scratch(spark, "loads")
    _arriving(spark, _samples(spark, sf_dir), "sample", lambda s: state.once(state.cpu_load_stream(s, None), path, f"{path}-state", "update"))
    return state.taken(spark, path, state.LOAD).groupBy("host", "sample").agg(F.max_by("load", "batch_no").alias("load"))


def stream_flush_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of all users as a stream with state per user: the batches of text that it hands on."""
    state.use_rocksdb(spark)
    chunks = _chunks(spark, sf_dir).select("stream", "seq", "ms", F.expr("repeat('x', CAST(chars AS INT))").alias("text"), F.lit(False).alias("end"))
    path = scratch(spark, "flushed")
    _arriving(spark, chunks, "seq", lambda s: state.once(state.flush_chunks(s, None), path, f"{path}-state"))
    return state.taken(spark, path, state.BATCH).select("stream", "batch", F.length("text").cast("long").alias("chars"))


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk per event: its stream is the user, its length comes from the id; time runs in steps of a tenth of the id."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("stream"), F.col("event_id").alias("seq"), F.floor(F.col("event_id") / 10).alias("ms"), (F.col("event_id") * 37 % 400).alias("chars"), "event_type")


def stream_flush_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitoring.flush_batches(_chunks(spark, sf_dir)).select("stream", "seq", "batch")


FLUSH_SQL = """
WITH RECURSIVE c AS (SELECT user_id AS stream, event_id AS seq, event_id // 10 AS ms, event_id * 37 % 400 AS chars, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
f AS (SELECT stream, seq, rn, 0::BIGINT AS batch, CASE WHEN chars >= 1024 THEN 0 ELSE chars END AS pending, ms AS last, (chars >= 1024)::BIGINT AS closed FROM c WHERE rn = 1
      UNION ALL
      SELECT c.stream, c.seq, c.rn, f.batch + f.closed, CASE WHEN c.chars > 0 AND (f.pending + c.chars >= 1024 OR c.ms - f.last >= 90) THEN 0 ELSE f.pending + c.chars END,
             CASE WHEN c.chars > 0 AND (f.pending + c.chars >= 1024 OR c.ms - f.last >= 90) THEN c.ms ELSE f.last END, (c.chars > 0 AND (f.pending + c.chars >= 1024 OR c.ms - f.last >= 90))::BIGINT
      FROM f JOIN c ON c.stream = f.stream AND c.rn = f.rn + 1)
SELECT stream, seq, batch FROM f"""


#: Only batches that have been closed are handed on.
FLUSH_STATE_SQL = FLUSH_SQL.replace("SELECT stream, seq, batch FROM f", "SELECT stream, batch, sum(c.chars)::BIGINT AS chars FROM f JOIN c USING (stream, rn) GROUP BY stream, batch HAVING max(closed) = 1")


def stream_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitoring.stream_digests(_chunks(spark, sf_dir).withColumnRenamed("event_type", "piece"))


CONCAT_SQL = "SELECT user_id AS stream, md5(string_agg(event_type, '' ORDER BY event_id)) AS digest, count(*) AS chunks FROM events GROUP BY user_id"

_DE = {"app": {"title": "Titel", "open": "Öffne {{name}}"}, "n": {"file_one": "{{count}} Datei", "file_other": "{{count}} Dateien"}, "list": ["a"]}
_CATALOGUES = [("de", _DE), ("en", {"app": {"title": "Title", "open": "Open {{name}}"}, "n": {"file_one": "x", "file_other": "{{count}} files"}, "list": ["b"]}), ("fr", {"app": {"title": "Titre", "more": {"deep": "{{b}} {{a}}"}}, "n": {"file_many": "m", "file_other": "{{n}}"}})]


def _flat(spark: SparkSession) -> DataFrame:
    return catalogues.flatten(literal_rows(spark, [(lang, json.dumps(body, ensure_ascii=False)) for lang, body in _CATALOGUES], "lang string, body string"))


def i18n_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogues.parity(_flat(spark), "de")


_PARITY = [("fr", "app.open", "missing"), ("fr", "list", "missing"), ("fr", "app.more.deep", "extra")]


def i18n_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(spark).select("lang", "path", F.array_join(catalogues.placeholders(F.col("value")), ",").alias("names"))


_NAMES = [
    ("de", "app.title", ""), ("de", "app.open", "name"), ("de", "n.file_one", "count"), ("de", "n.file_other", "count"), ("de", "list", ""), ("en", "app.title", ""), ("en", "app.open", "name"), ("en", "n.file_one", ""),
    ("en", "n.file_other", "count"), ("en", "list", ""), ("fr", "app.title", ""), ("fr", "app.more.deep", "a,b"), ("fr", "n.file_many", ""), ("fr", "n.file_other", "n"),
]

def event_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    later = F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("event_id") % 90).cast("decimal(18,6)"))
    return table(spark, sf_dir, "events").select(
        "event_id", dates.iso_ms(F.col("ts")).alias("iso"), dates.day_key(F.col("ts")).alias("day"), dates.german_short(F.col("ts")).alias("short"), dates.german_long(F.col("ts")).alias("long"), dates.duration_ms(F.col("ts"), later).alias("ms"), dates.from_iso(dates.iso_ms(F.col("ts"))).isNotNull().alias("parses"),
    )


DATES_SQL = f"""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS iso, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%d.%m.%Y, %H:%M') AS short,
 day(ts) || '. ' || {list(dates.MONTHS)}[month(ts)] || strftime(ts, ' %Y um %H:%M') AS long, (event_id % 90) * 1000 AS ms, true AS parses FROM events"""


def ram_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    total, free = F.lit(17_179_869_184).cast("long"), F.col("event_id") * 1_700_003
    return table(spark, sf_dir, "events").select("event_id", monitoring.ram_usage(total, free).alias("r")).select("event_id", "r.total_gb", "r.used_gb", "r.used_percent")


RAM_SQL = """WITH r AS (SELECT event_id, 17179869184 AS total, 17179869184 - event_id * 1700003 AS used FROM events)
SELECT event_id, round(total / 1073741824::DOUBLE, 1) AS total_gb, round(used / 1073741824::DOUBLE, 1) AS used_gb, floor(used / total::DOUBLE * 100 + 0.5)::BIGINT AS used_percent FROM r"""

_FAILURES = [(1, '{"message": "fetch failed", "name": "TypeError", "cause": {"message": "reset", "name": "Error", "code": "ECONNRESET"}}'), (2, '{"message": "m", "name": "Error", "cause": "text"}'), (3, '{"message": "m", "name": "Error"}'), (4, "plain")]


def error_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return literal_rows(spark, _FAILURES, "id int, raw string").select("id", dates.error_metadata(F.col("raw")).alias("e")).select("id", "e.*")


_CHAINS = [(1, "fetch failed", "TypeError", "reset", "Error", "ECONNRESET"), (2, "m", "Error", "text", None, None), (3, "m", "Error", None, None, None), (4, "plain", None, None, None, None)]


def events_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch form of the windowed metrics stream."""
    counted = streams.windowed_metrics(table(spark, sf_dir, "events"), width="1 hour")
    return counted.select(dates.iso_ms(F.col("window.start")).alias("hour"), "event_type", "n")


HOURLY_SQL = "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%dT%H:%M:%S.%gZ') AS hour, event_type, count(*) AS n FROM events GROUP BY ALL"


def stream_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last phase of each stream and the whole percentage of its latest progress."""
    events = table(spark, sf_dir, "events")
    at = F.struct("ts", "event_id")
    newest = streams.latest(events, "user_id", at, F.struct("event_type", "event_id"))
    return newest.select("user_id", F.col("latest.event_type").alias("phase"), streams.progress(F.col("latest.event_id") % 101, F.lit(100)).alias("percent"))


PHASE_SQL = "SELECT user_id, event_type AS phase, event_id % 101 AS percent FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"

def log_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines appended to day folders, read back from them."""
    path = scratch(spark, "logs")
    rows = table(spark, sf_dir, "events").select("ts", F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "view", "info").otherwise(F.col("event_type")).alias("level"), F.lit("events").alias("source"), F.col("event_type").alias("message"), F.col("event_id").cast("string").alias("meta"))
    monitoring.write_logs(rows, path)
    return spark.read.schema("lvl string, src string, msg string, meta string, day string").json(path).select(F.col("day").cast("string"), "lvl", "src", "msg", F.col("meta").cast("long").alias("event_id"))


LOG_WRITE_SQL = """SELECT strftime(ts, '%Y-%m-%d') AS day, CASE event_type WHEN 'view' THEN 'info' ELSE event_type END AS lvl, 'events' AS src, event_type AS msg, event_id
FROM events WHERE event_type IN ('view', 'error')"""


def derived_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", dates.derived_id(F.col("event_type"), F.col("event_id")).alias("id"))


_HASH = "sha256(event_type || chr(1) || event_id)"
DERIVED_SQL = f"SELECT event_id, concat_ws('-', h[1:8], h[9:12], h[13:16], h[17:20], h[21:32]) AS id FROM (SELECT event_id, {_HASH} AS h FROM events)"

def error_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each error event with the same user's newest other event at or before it."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    found = asof.nearest_before(events.where("event_type = 'error'"), events.where("event_type <> 'error'"), ["user_id"], "ts", ["event_id"], scratch(spark, "as-of"))
    return found.select("event_id", F.col("right_event_id").alias("before_id"), F.col("right_event_type").alias("before_type"))


ERROR_CONTEXT_SQL = """SELECT e.event_id, b.event_id AS before_id, b.event_type AS before_type
FROM (SELECT * FROM events WHERE event_type = 'error') e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type <> 'error') b ON e.user_id = b.user_id AND e.ts >= b.ts"""


def error_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors and the same user's clicks in the two hours before: the batch form of the interval join of two streams."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    pairs = streams.within(events.where("event_type = 'error'"), events.where("event_type = 'click'"), "user_id", "2 HOURS")
    return pairs.select("event_id", F.col("right_event_id").alias("click_id"))


CAUSES_SQL = "SELECT e.event_id, c.event_id AS click_id FROM events e JOIN events c ON e.user_id = c.user_id AND c.ts BETWEEN e.ts - INTERVAL 2 HOUR AND e.ts WHERE e.event_type = 'error' AND c.event_type = 'click'"


def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users that end after twelve hours without an event: the batch form of the stream."""
    found = streams.sessions(table(spark, sf_dir, "events"), "user_id", "12 hours")
    return found.select("user_id", dates.iso_ms(F.col("start")).alias("start"), dates.iso_ms(F.col("last")).alias("last"), "n")


SESSIONS_SQL = """
WITH g AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER w >= INTERVAL 12 HOUR, true) AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(opens::INT) OVER (PARTITION BY user_id ORDER BY ts) AS no FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%dT%H:%M:%S.%gZ') AS start, strftime(max(ts), '%Y-%m-%dT%H:%M:%S.%gZ') AS last, count(*) AS n FROM s GROUP BY user_id, no"""

QUERIES = {
    "error_context": (error_context, ERROR_CONTEXT_SQL),
    "error_causes": (error_causes, CAUSES_SQL),
    "user_sessions": (user_sessions, SESSIONS_SQL),
    "log_write": (log_write, LOG_WRITE_SQL),
    "derived_ids": (derived_ids, DERIVED_SQL),
    "log_retention": (log_retention, RETENTION_SQL),
    "log_size_cap": (log_size_cap, CAP_SQL),
    "log_level_filter": (log_level_filter, LEVEL_SQL),
    "cpu_load_delta": (cpu_load_delta, CPU_SQL),
    "active_streams": (active_streams, ACTIVE_SQL),
    "active_streams_total": (active_streams_total, ACTIVE_TOTAL_SQL),
    "cpu_load_stream": (cpu_load_stream, CPU_SQL),
    "stream_flush_state": (stream_flush_state, FLUSH_STATE_SQL),
    "stream_flush_batches": (stream_flush_batches, FLUSH_SQL),
    "stream_concat": (stream_concat, CONCAT_SQL),
    "event_dates": (event_dates, DATES_SQL),
    "ram_metrics": (ram_metrics, RAM_SQL),
    "error_chain": (error_chain, f"SELECT * FROM {values_sql(_CHAINS, 'id, error, name, cause_message, cause_name, cause_code')}"),
    "events_hourly": (events_hourly, HOURLY_SQL),
    "stream_phase": (stream_phase, PHASE_SQL),
    "i18n_parity": (i18n_parity, f"SELECT * FROM {values_sql(_PARITY, 'lang, key, difference')}"),
    "i18n_placeholders": (i18n_placeholders, f"SELECT * FROM {values_sql(_NAMES, 'lang, path, names')}"),
}
