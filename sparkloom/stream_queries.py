"""Queries that run streams over replayed tables, each until all is read, with the SQL of what they come to."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import functions as F
from pyspark.sql import types as T

from .catalog_queries import _t, query
from .operators.hierarchy import shared_folder
from .operators.tables import Buckets
from .streaming import timers
from .streaming.edits import debounced, windowed
from .streaming.replay import replay, to_files


@contextmanager
def _setting(spark, name, value):
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


#: A time after all events, whose arrival lets every window and timer end.
END = "2100-01-01 00:00:00"
SLICES = 3


def _slices(rows, at):
    """Adds ``slice``: 0 to SLICES - 1 by parts of equal length of the time from the first to the last row."""
    t = F.expr(f"unix_micros(cast({at} as timestamp))")
    bounds = rows.agg(F.min(t).alias("low"), F.max(t).alias("high")).first()
    if bounds["low"] is None:
        return rows.withColumn("slice", F.lit(0))
    return rows.withColumn("slice", ((t - bounds["low"]) * SLICES / (bounds["high"] - bounds["low"] + 1)).cast("int"))


def _with_end(rows, **values):
    """Adds a last slice with one row at END."""
    one = rows.sparkSession.range(1).select(*[F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in rows.schema.fields])
    return rows.unionByName(one)


@query(
    "SELECT user_id, max(event_id) AS value, max(h) AS at, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY h ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, CASE WHEN h - lag(h) OVER (PARTITION BY user_id ORDER BY h) < 43200 THEN 0 ELSE 1 END AS new FROM (SELECT user_id, event_id, epoch_us(ts) // 1000000 AS h FROM events))) GROUP BY user_id, run"
)
def stream_debounce(spark, d):
    """The last call of each user before half a day of quiet, by timers, over events that come in several batches."""
    events = _slices(_t(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id"), "ts")
    out = f"{shared_folder(spark)}/debounced-{uuid.uuid4().hex}"
    with _setting(spark, *timers.PROVIDER):
        start = lambda stream, at: to_files(timers.debounced(stream, "user_id", "ts", "event_id", 43_200), out, at)
        replay(_with_end(events, user_id=-1, event_id=-1, ts=END, slice=SLICES), [*range(SLICES + 1)], "slice", start, "debounce")
    return spark.read.schema("user_id long, value long, at long, n long").parquet(out).where("user_id >= 0")


#: Events arrive up to 12 hours late; a window waits for 3 hours, a session for 13.
ARRIVED = "cast(ts as timestamp) + make_dt_interval(0, cast(event_id * 7919 % 13 as int))"
ARRIVED_SQL = "ts + to_hours(CAST(event_id * 7919 % 13 AS INTEGER))"


def _arriving(spark, d):
    """Events in slices by the time at which they arrive."""
    e = _t(spark, d, "events").select(F.expr(ARRIVED).alias("arrived"), F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_id", "event_type")
    return _slices(e, "arrived").drop("arrived")


def _windows(spark, d, width, slide):
    """(start, event_type, n, n_late): events of each window that came in time, and those that its watermark let go."""
    events = _arriving(spark, d)
    out = f"{shared_folder(spark)}/windows-{uuid.uuid4().hex}"
    start = lambda stream, at: to_files(windowed(stream, "event_type", "ts", width, slide, "3 hours").select("event_type", "window.start", "n"), out, at)
    replay(_with_end(events, ts=END, slice=SLICES), [*range(SLICES + 1)], "slice", start, "windows")
    came = spark.read.schema("event_type string, start timestamp, n long").parquet(out)
    every = events.groupBy("event_type", F.window("ts", width, slide).alias("w")).agg(F.count("*").alias("n_all")).select("event_type", "w.start", "n_all")
    n = F.coalesce("n", F.lit(0))
    return every.join(came, ["event_type", "start"], "left").select(F.unix_seconds("start").alias("start"), "event_type", n.alias("n"), (F.col("n_all") - n).alias("n_late"))


def _windows_sql(width: int, slide: int) -> str:
    """The same by a rule: a row is late for a window that ends before the watermark, 3 hours before the last event of the slices that came before its own."""
    return f"""WITH e AS (SELECT event_type, epoch_us(ts) AS t, epoch_us({ARRIVED_SQL}) AS a FROM events), b AS (SELECT min(a) AS low, max(a) AS high FROM e),
    s AS (SELECT event_type, t, CAST(floor((a - low) * {SLICES} / (high - low + 1)) AS INTEGER) AS slice FROM e, b),
    m AS (SELECT slice, max(max(t) // 1000) OVER (ORDER BY slice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 10800000 AS mark FROM s GROUP BY slice),
    w AS (SELECT s.*, mark, (t // 1000000 // {slide} - k) * {slide} AS start FROM s JOIN m USING (slice), range({width // slide}) r(k))
    SELECT start, event_type, count(*) FILTER (mark IS NULL OR (start + {width}) * 1000 > mark) AS n, count(*) FILTER (mark IS NOT NULL AND (start + {width}) * 1000 <= mark) AS n_late FROM w GROUP BY ALL"""


@query(_windows_sql(21_600, 21_600))
def stream_tumbling(spark, d):
    """Windows of 6 hours over events that come up to half a day late."""
    return _windows(spark, d, "6 hours", None)


@query(_windows_sql(21_600, 7_200))
def stream_sliding(spark, d):
    """Windows of 6 hours, one every 2 hours."""
    return _windows(spark, d, "6 hours", "2 hours")


@query(
    "SELECT user_id, arg_max(event_id, (t, event_id)) AS event_id, min(t) // 1000000 AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t, event_id) AS run FROM (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) <= 14400000000 THEN 0 ELSE 1 END AS new FROM (SELECT user_id, event_id, epoch_us(ts) AS t FROM events))) GROUP BY user_id, run"
)
def stream_sessions(spark, d):
    """Sessions of a user's events, 4 hours apart at most, whatever the order in which they come; the watermark waits for the latest."""
    out = f"{shared_folder(spark)}/sessions-{uuid.uuid4().hex}"
    start = lambda stream, at: to_files(debounced(stream.withColumn("at", F.unix_micros("ts")), "user_id", "ts", "4 hours", "13 hours").select("user_id", "last.event_id", F.unix_seconds("run.start").alias("start"), "n"), out, at)
    replay(_with_end(_arriving(spark, d), ts=END, user_id=-1, slice=SLICES), [*range(SLICES + 1)], "slice", start, "sessions")
    return spark.read.schema("user_id long, event_id long, start long, n long").parquet(out).where("user_id >= 0")


#: What happens to the documents, in order: all come, some are edited and edited again, some go, some come back or are sent unchanged.
CHANGES_SQL = """SELECT doc_id, 0 AS slice, doc_id * 10 AS seq, text, false AS deleted FROM documents UNION ALL SELECT doc_id, 1, doc_id * 10 + k, text || ' edit ' || k, false FROM documents, (SELECT unnest([1, 2]) AS k) WHERE doc_id % 3 = 1
UNION ALL SELECT doc_id, 2, doc_id * 10, NULL, true FROM documents WHERE doc_id % 5 = 2 UNION ALL SELECT doc_id, 3, doc_id * 10, text, false FROM documents WHERE doc_id % 7 = 3"""
STATE_SQL = f"SELECT doc_id, sha1(text) AS digest, len(regexp_extract_all(text, '[a-zA-Z]+')) AS n_words FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY slice DESC, seq DESC) AS r FROM ({CHANGES_SQL})) WHERE r = 1 AND NOT deleted"
#: What is kept of a document.
STATE = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("digest", T.StringType()), T.StructField("n_words", T.LongType())])


def _derived(docs):
    """The rows to keep of documents as they come, and whether they go."""
    return docs.select("doc_id", "seq", "deleted", F.sha1("text").alias("digest"), F.regexp_count("text", F.lit("[a-zA-Z]+")).cast("long").alias("n_words"))


def _changes(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "text")
    seq = F.col("doc_id") * 10
    none, no = F.lit(None).cast("string"), F.lit(False)
    rows = [
        docs.select("doc_id", F.lit(0).alias("slice"), seq.alias("seq"), "text", no.alias("deleted")),
        docs.where("doc_id % 3 = 1").select("doc_id", F.lit(1), F.explode(F.array(F.lit(1), F.lit(2))).alias("k"), "text").select("doc_id", F.lit(1), seq + F.col("k"), F.concat("text", F.lit(" edit "), F.col("k").cast("string")), no),
        docs.where("doc_id % 5 = 2").select("doc_id", F.lit(2), seq, none, F.lit(True)),
        docs.where("doc_id % 7 = 3").select("doc_id", F.lit(3), seq, "text", no),
    ]
    return rows[0].union(rows[1]).union(rows[2]).union(rows[3])


def _state(spark, label):
    return Buckets(spark, f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}", "doc_id", STATE, 16)


@query(STATE_SQL)
def stored_sync(spark, d):
    """What is kept of the documents after four batches of changes, each written to the buckets that it touches."""
    state, changes = _state(spark, "sync"), _changes(spark, d)
    for one in range(4):
        state.upsert(_derived(changes.where(F.col("slice") == one)), "seq", F.col("deleted"), "digest", one)
        state.vacuum()
    return state.read()


@query(STATE_SQL)
def stream_sync(spark, d):
    """The same changes as files that a stream reads; every batch is applied once, by its number."""
    state = _state(spark, "stream-sync")

    def apply(batch, number):
        state.upsert(_derived(batch), "seq", F.col("deleted"), "digest", number)
        state.vacuum()

    start = lambda stream, at: stream.writeStream.foreachBatch(apply).option("checkpointLocation", at).trigger(availableNow=True).start()
    replay(_changes(spark, d), [0, 1, 2, 3], "slice", start, "changes")
    return state.read()
