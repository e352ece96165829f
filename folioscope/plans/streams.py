"""Queries that run streams: events and documents arrive in waves, some of them late, and runs go on from their checkpoints."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.store import scratch
from ..streaming import jobs
from ..streaming.progress import ProgressLog
from ..streaming.versions import Versions
from .registry import query, table

#: How far behind the newest row one may come, what is reported by a slower way, and the time to a purchase (fixed values of these queries).
LATE, SLOW_VALUE, GAP, WITHIN = "2 days", 30.0, "2 hours", "6 hours"

#: The first half of the time, but for what comes by the slower way; then the rest, with all late rows.
FIRST = f"""b AS (SELECT (epoch_us(min(ts)) + epoch_us(max(ts))) // 2 AS half FROM events),
    e AS (SELECT events.*, epoch_us(ts) AS us, epoch_us(ts) < half AND NOT coalesce(value > {SLOW_VALUE}, FALSE) AS early FROM events, b)"""
DAYS = 2 * 86_400_000


def event_waves(spark, sf_dir):
    """(schema, the two waves) of the events."""
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    half = events.agg(((F.unix_micros(F.min("ts")) + F.unix_micros(F.max("ts"))) / 2).cast("long").alias("half")).first()["half"]
    early = (F.unix_micros("ts") < half) & ~F.coalesce(F.col("value") > SLOW_VALUE, F.lit(False))
    return events.schema, [events.where(early), events.where(~early)]


def in_waves(spark, sf_dir, build, name, each=None, mode="append", log=None):
    """Let the waves arrive one after the other and run the stream after each; the path of what it wrote."""
    schema, waves = event_waves(spark, sf_dir)
    folder, out, checkpoint = (scratch(spark, f"{name}-{part}") for part in ("in", "out", "checkpoint"))
    for wave in waves:
        wave.write.mode("append").parquet(folder)
        done = jobs.work_off(build(jobs.arrived(spark, folder, schema)), checkpoint, out, each, mode, name)
        if log is not None:
            log.wait(done)
    return out


@query(
    "stream_windows",
    f"""WITH {FIRST}, m AS (SELECT (max(us) FILTER (early) // 1000 - {DAYS}) * 1000 AS mark FROM e)
    SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n, round(sum(value), 4) AS value
    FROM e, m WHERE early OR epoch_us(date_trunc('hour', ts) + INTERVAL 1 HOUR) > mark GROUP BY ALL""",
)
def stream_windows(spark, sf_dir):
    """Hourly counts, brought up to date batch by batch; rows of hours that the watermark has closed are dropped."""
    shape = jobs.windowed_counts(table(spark, sf_dir, "events"))
    counts = Versions(spark, scratch(spark, "windows"), ["window_start", "event_type"], shape.schema)
    in_waves(spark, sf_dir, lambda e: jobs.windowed_counts(e, late=LATE), "stream_windows", counts.put, "update")
    return counts.current().select(F.date_format("window_start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n", F.round("value", 4).alias("value"))


@query(
    "stream_sessions",
    f"""WITH {FIRST}, m AS (SELECT (max(us) FILTER (early) // 1000 - {DAYS}) * 1000 AS mark, (max(us) // 1000 - {DAYS}) * 1000 AS last FROM e),
    -- sessions of the first wave; those that end before the mark are closed, the others go on with the second
    a AS (SELECT *, sum(begins) OVER (PARTITION BY user_id ORDER BY us, event_id) AS s FROM (
        SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) < 7200000000 THEN 0 ELSE 1 END AS begins FROM e WHERE early)),
    a_end AS (SELECT *, max(us) OVER (PARTITION BY user_id, s) + 7200000000 AS end_us FROM a),
    open AS (SELECT user_id, us, event_id, value FROM a_end, m WHERE end_us > mark UNION ALL SELECT user_id, us, event_id, value FROM e, m WHERE NOT early AND us + 7200000000 > mark),
    b2 AS (SELECT *, sum(begins) OVER (PARTITION BY user_id ORDER BY us, event_id) AS s FROM (
        SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) < 7200000000 THEN 0 ELSE 1 END AS begins FROM open)),
    closed AS (
        SELECT user_id, s, us, value FROM a_end, m WHERE end_us <= mark
        UNION ALL SELECT user_id, -s, us, value FROM (SELECT *, max(us) OVER (PARTITION BY user_id, s) + 7200000000 AS end_us FROM b2), m WHERE end_us <= last)
    SELECT user_id, min(us) AS session_start, max(us) + 7200000000 AS session_end, count(*) AS n, round(sum(value), 4) AS value FROM closed GROUP BY user_id, s""",
)
def stream_sessions(spark, sf_dir):
    """The sessions of users that the watermark has closed, late rows aside."""
    events, _ = event_waves(spark, sf_dir)
    out = in_waves(spark, sf_dir, lambda e: jobs.sessions(e, gap=GAP, late=LATE), "stream_sessions")
    found = spark.read.parquet(out)
    return found.select("user_id", F.unix_micros("session_start").alias("session_start"), F.unix_micros("session_end").alias("session_end"), "n", F.round("value", 4).alias("value"))


@query(
    "stream_followed",
    f"""WITH {FIRST}, m AS (SELECT (least(max(us) FILTER (early AND event_type = 'view'), max(us) FILTER (early AND event_type = 'purchase')) // 1000 - {DAYS}) * 1000 AS mark FROM e),
    t AS (SELECT e.* FROM e, m WHERE early OR us > mark)
    SELECT v.event_id, p.event_id AS then_event_id, v.user_id, p.us - v.us AS waited
    FROM t v JOIN t p ON v.user_id = p.user_id AND p.us BETWEEN v.us AND v.us + 21600000000 WHERE v.event_type = 'view' AND p.event_type = 'purchase'""",
)
def stream_followed(spark, sf_dir):
    """Views and the purchases of their users soon after: two streams joined, whose state is cleared by time."""

    def build(events):
        return jobs.followed(events.where("event_type = 'view'"), events.where("event_type = 'purchase'"), "user_id", within=WITHIN, late=LATE)

    met = spark.read.parquet(in_waves(spark, sf_dir, build, "stream_followed"))
    return met.select("event_id", "then_event_id", "user_id", (F.unix_micros("then_ts") - F.unix_micros("ts")).alias("waited"))


@query(
    "stream_progress",
    f"""WITH {FIRST} SELECT CASE WHEN early THEN 0 ELSE 1 END AS run, count(*) AS input_rows FROM e GROUP BY ALL""",
)
def stream_progress(spark, sf_dir):
    """The rows that each run of a stream took in, by its listener."""
    with ProgressLog(spark, scratch(spark, "progress")) as log:
        in_waves(spark, sf_dir, lambda e: jobs.timed(e, late=LATE).select("event_id", "ts"), "stream_progress", log=log)
    batches = log.table().where("kind = 'batch' and input_rows > 0").groupBy("run").agg(F.sum("input_rows").alias("input_rows"), F.min("batch").alias("first"))
    # a handful of rows: one a run
    runs = [r["run"] for r in batches.orderBy("first").collect()]
    number = F.array_position(F.array(*map(F.lit, runs)), F.col("run")) - 1
    return batches.select(number.cast("int").alias("run"), "input_rows")


@query(
    "stream_documents",
    "SELECT doc_id, lang, length(text) AS n_chars, len(string_split(coalesce(text, ''), chr(10))) AS n_lines FROM documents",
)
def stream_documents(spark, sf_dir):
    """Documents that arrive as drafts, then in full, in three waves, converted as they come; the newest version of each counts.

    The second wave's last batch is put in again, as after a failure, and changes nothing; then the log is folded.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    draft = docs.withColumn("text", F.substring_index("text", "\n", 1))
    other = F.coalesce(F.col("lang") != "en", F.lit(True))
    folder, checkpoint = scratch(spark, "documents-in"), scratch(spark, "documents-checkpoint")

    def convert(rows):
        return rows.select("doc_id", "lang", F.length("text").cast("long").alias("n_chars"), F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long").alias("n_lines"))

    done = Versions(spark, scratch(spark, "documents"), ["doc_id"], convert(docs).schema)
    last = {}

    def each(batch, batch_id):
        done.put(batch, batch_id)
        last["id"] = batch_id

    for i, wave in enumerate((draft, docs.where(other), docs.where(~other))):
        wave.write.mode("append").parquet(folder)
        jobs.work_off(convert(jobs.arrived(spark, folder, docs.schema)), checkpoint, each=each)
        if i == 1:
            done.put(convert(wave), last["id"])
            done.compact()
            done.put(convert(draft), last["id"])
    return done.current()
