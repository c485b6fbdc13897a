"""Queries over ``events`` as a stream: run to the end of the log, compared with one SQL statement over it."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..streaming import feeds
from .common import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _place(spark, name: str) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"
    return f"{base}/stream-{name}-{uuid.uuid4().hex}"


def _events(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(sf_dir) if not _is_folder(spark, sf_dir) else feeds.log_stream(spark, f"{sf_dir}/events.parquet", schema)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def _is_folder(spark, sf_dir) -> bool:
    """Whether ``events`` is a folder of files; a stream reads folders only."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/events.parquet")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()


def _drained(spark, name, df):
    place = _place(spark, name)
    return feeds.drain(df, f"{place}/out", f"{place}/state")


@query("""SELECT user_id, event_type, max(event_id) AS revision FROM events GROUP BY ALL""")
def t1_change_feed(spark, sf_dir):
    """The newest revision of each cell; what is delivered twice counts once."""
    feed = _events(spark, sf_dir)
    seen = _drained(spark, "t1", feeds.revisions(feed, "user_id", "event_id", "ts").select("user_id", "event_type", "event_id"))
    return seen.groupBy("user_id", "event_type").agg(F.max("event_id").alias("revision"))


T1_PAGES = """
WITH RECURSIVE g AS (SELECT user_id // 20 AS run, list_sort(list(DISTINCT event_id)) AS ids FROM events WHERE user_id IS NOT NULL GROUP BY run),
p AS (SELECT run, ids, -1::BIGINT AS since, 0::BIGINT AS page, -1::BIGINT AS latest, []::BIGINT[] AS part FROM g
  UNION ALL SELECT run, ids, greatest(since, x[-1] - 50), page + 1, x[-1], list_filter(x, lambda v: v > latest) FROM (SELECT *, list_filter(ids, lambda v: v > since)[1:100] AS x FROM p) WHERE x[-1] > latest)
SELECT run, page, unnest(part) AS event_id FROM p WHERE page > 0"""


@query(T1_PAGES)
def t1_paged_feed(spark, sf_dir):
    """The events of runs of twenty users each as a reader of pages of 100 with an overlap of 50 gets them."""
    runs = _events(spark, sf_dir).withColumn("run", F.expr("user_id div 20"))
    return _drained(spark, "t1-pages", feeds.paged(runs, "run", "event_id", limit=100, start=-1))


T3 = """
WITH w AS (SELECT user_id, date_trunc('day', ts) AS window_start, count(*) AS n FROM events GROUP BY ALL)
SELECT user_id, window_start, n, n - 3 AS refused, window_start + INTERVAL 1 DAY AS retry_at, window_start + INTERVAL 2 DAY AS expires_at FROM w WHERE n > 3 AND window_start + INTERVAL 1 DAY <= (SELECT max(ts) FROM events)"""


@query(T3)
def t3_tumbling_limit(spark, sf_dir):
    """Windows over a limit of three calls a day that the stream has closed."""
    out = _drained(spark, "t3", feeds.limited(_events(spark, sf_dir), "ts", ["user_id"], "1 day", 3))
    return out.select("user_id", *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("window_start", "retry_at", "expires_at")), "n", "refused")


T4 = """
WITH s AS (SELECT user_id, unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS window_start FROM events)
SELECT user_id, window_start, count(*) AS n FROM s GROUP BY ALL HAVING count(*) >= 6"""


@query(T4)
def t4_sliding_counts(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return feeds.window_counts(e, "ts", ["user_id"], "2 days", slide="1 day").where("n >= 6").select("user_id", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n")


#: Microseconds in which a bucket refills one request and one token; requests and tokens that it holds.
REQUEST_US, TOKEN_US, REQUESTS, TOKENS = 600_000_000, 2_000_000, 3, 900

T5 = f"""
WITH c AS (SELECT event_id, user_id, epoch_us(ts) AS t, {REQUEST_US}::BIGINT AS a, least(round(value)::BIGINT * {TOKEN_US}, {TOKENS * TOKEN_US}) AS b FROM events),
s AS (SELECT *, sum(a) OVER w AS sa, sum(b) OVER w AS sb FROM c WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING)),
m AS (SELECT *, min(sa - a - t) OVER w AS ma, min(sb - b - t) OVER w AS mb FROM s WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING))
SELECT event_id, greatest(0, sa - t - ma - {REQUESTS * REQUEST_US}, sb - t - mb - {TOKENS * TOKEN_US})::BIGINT AS wait_us FROM m"""


@query(T5)
def t5_token_bucket(spark, sf_dir):
    """Waiting times of all calls of all users behind two buckets: a request each ten minutes, three at once, and a token each two seconds."""
    calls = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    tokens = F.round("value").cast("long") * TOKEN_US
    waits = feeds.bucket_waits(calls, "user_id", "ts", "event_id", {"requests": (F.lit(REQUEST_US), REQUESTS * REQUEST_US), "tokens": (tokens, TOKENS * TOKEN_US)})
    return waits.select("event_id", "wait_us")


T6 = """
WITH c AS (SELECT event_id, user_id, round(value)::BIGINT AS k FROM events)
SELECT k, min(event_id) AS made_by, count(*) - 1 AS replayed FROM c GROUP BY k"""


@query(T6)
def t6_exactly_once(spark, sf_dir):
    """Paid calls are made once for each key and replayed after that: batches append what their keys lack."""
    feed, place = _events(spark, sf_dir).select("event_id", F.round("value").cast("long").alias("k")), _place(spark, "t6")
    feeds.drain_batches(feed, f"{place}/state", feeds.answered_once(f"{place}/answers", "k", "event_id"), "append")
    answers = feeds.answers(spark, f"{place}/answers", "k")
    calls = table(spark, sf_dir, "events").select(F.round("value").cast("long").alias("k")).groupBy("k").agg((F.count("*") - 1).alias("replayed"))
    return answers.join(calls, "k").select("k", "made_by", "replayed")


T7 = """SELECT user_id, count(*) AS n_stale FROM events WHERE event_type = 'signup' AND ts + INTERVAL 2 DAY <= TIMESTAMP '2024-01-15' GROUP BY 1"""


@query(T7)
def t7_stale_leases(spark, sf_dir):
    claims = table(spark, sf_dir, "events").where("event_type = 'signup'").withColumn("ts", F.col("ts").cast("timestamp"))
    return feeds.stale(claims, "ts", "2024-01-15", "2 days").groupBy("user_id").agg(F.count("*").alias("n_stale"))


T9 = """SELECT event_id, max(greatest(10, least(99, 10 + floor(89 * value / 500)))) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS progress FROM events"""


@query(T9)
def t9_monotone_progress(spark, sf_dir):
    now = F.greatest(F.lit(10), F.least(F.lit(99), 10 + F.floor(89 * F.col("value") / 500)))
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "events").select("event_id", F.max(now).over(w).cast("long").alias("progress"))


@query("""SELECT event_id, least(value, 60 + value / 2) AS hedged FROM events""")
def t10_hedged_latency(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.least(F.col("value"), 60 + F.col("value") / 2).alias("hedged"))
