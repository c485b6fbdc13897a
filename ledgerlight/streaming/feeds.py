"""Structured Streaming over append logs: change feeds, rate windows, token buckets, leases, expiry.

Every function takes a streaming (or static) DataFrame and returns one; ``drain`` runs a
streaming result to the end of its input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def log_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int | None = None) -> DataFrame:
    """An append log of Parquet files as a stream."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def drain(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run ``stream`` over all that is there into Parquet files at ``out`` and read them."""
    q = stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def drain_batches(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "update") -> None:
    q = stream.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def revisions(feed: DataFrame, key: str, revision: str, at: str, delay: str = "10 minutes") -> DataFrame:
    """Each (key, revision) once, however often the feed delivers it again within ``delay``."""
    return feed.withWatermark(at, delay).dropDuplicatesWithinWatermark([key, revision])


def next_since(since: int, largest: int | None, overlap: int = 50) -> int:
    """Where the next page begins: a little before the end, since sequence order is not commit order."""
    return since if largest is None else max(since, largest - overlap)


def paged(feed: DataFrame, run: str, seq: str, limit: int = 500, overlap: int = 50, start: int = 0) -> DataFrame:
    """(run, page, seq): the change feed of each run as its reader takes it, page by page, each change once.

    A page holds at most ``limit`` changes after the place where it begins; the next begins
    ``overlap`` before its end, since order of sequence is not order of commit. What it reads
    again is dropped; a change that comes later than the overlap reaches is missed, as are
    nulls. Between batches a run keeps where it is and the numbers seen in the overlap: no
    more than ``overlap`` of them, so state stays small however long a run is. A batch's
    changes of one run are read by one task; ``log_stream`` bounds them by files.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    if limit <= overlap:
        raise ValueError("a page must be longer than the overlap")

    def read(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        since, page, last = state.get if state.exists else (start, 0, [])
        seen, out = set(last), []
        waiting = sorted(seen.union(int(x) for f in frames for x in f[seq] if x > since))
        at = 0
        while at < len(waiting):
            part = waiting[at : at + limit]
            new = [x for x in part if x not in seen]
            if not new:
                break
            page += 1
            out += [(page, x) for x in new]
            since = next_since(since, part[-1], overlap)
            seen = {x for x in seen.union(new) if x > since}
            while at < len(waiting) and waiting[at] <= since:
                at += 1
        state.update((since, page, sorted(seen)))
        yield pd.DataFrame({run: [key[0]] * len(out), "page": [p for p, _ in out], seq: [x for _, x in out]})

    kind = {f.name: f.dataType.simpleString() for f in feed.schema}[run]
    known = feed.select(run, F.col(seq).cast("long").alias(seq)).dropna()
    return known.groupBy(run).applyInPandasWithState(read, f"`{run}` {kind}, page long, `{seq}` long", "since long, page long, seen array<long>", "append", GroupStateTimeout.NoTimeout)


def window_counts(events: DataFrame, at: str, keys: list[str], width: str, delay: str = "0 seconds", slide: str | None = None) -> DataFrame:
    """Counts by key in tumbling windows, or sliding ones with ``slide``."""
    marked = events.withWatermark(at, delay) if events.isStreaming else events
    w = F.window(at, width, slide) if slide else F.window(at, width)
    return marked.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), *keys, "n")


def limited(events: DataFrame, at: str, keys: list[str], width: str, limit: int, delay: str = "0 seconds") -> DataFrame:
    """Windows over the limit with the calls beyond it, when to try again and when the counter expires."""
    counts = window_counts(events, at, keys, width, delay).where(F.col("n") > limit)
    end = F.col("window_start") + F.expr(f"INTERVAL {width}")
    return counts.select(*keys, "window_start", "n", (F.col("n") - limit).alias("refused"), end.alias("retry_at"), (end + F.expr(f"INTERVAL {width}")).alias("expires_at"))


def bucket_waits(calls: DataFrame, key: str, at: str, order: str, buckets: dict[str, tuple[Column, int]], block: str = "day") -> DataFrame:
    """``calls`` with ``wait_us``: how long each waits, in order of time, until every bucket of its key holds its cost.

    A bucket is (cost, capacity), both as the microseconds in which it refills that much;
    costs above the capacity count as the capacity. What a key owes after call i is the
    largest, over j up to i, of the costs of calls j to i less the time from j to i: running
    sums and least values, so windows suffice. They run within a key's time blocks, and over
    the blocks' sums, so that no task holds all calls of a busy key.
    """
    own = Window.partitionBy(key, "_block").orderBy("_t", order)
    upto, before = own.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    got = calls.withColumn("_t", F.unix_micros(F.col(at))).withColumn("_block", F.date_trunc(block, F.col(at)))
    for name, (cost, most) in buckets.items():
        got = got.withColumn(f"_c_{name}", F.least(cost, F.lit(most)).cast("long"))
        got = got.withColumn(f"_s_{name}", F.sum(f"_c_{name}").over(upto)).withColumn(f"_m_{name}", F.min(F.col(f"_s_{name}") - F.col(f"_c_{name}") - F.col("_t")).over(upto))
    sums = got.groupBy(key, "_block").agg(*(f for n in buckets for f in (F.sum(f"_c_{n}").alias(f"_sum_{n}"), F.min(f"_m_{n}").alias(f"_min_{n}"))))
    for n in buckets:
        sums = sums.withColumn(f"_p_{n}", F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)))
    for n in buckets:
        sums = sums.withColumn(f"_l_{n}", F.min(F.col(f"_p_{n}") + F.col(f"_min_{n}")).over(before))
    both = got.join(sums.select(key, "_block", *(f"_{x}_{n}" for n in buckets for x in "pl")), [key, "_block"])
    owed = lambda n: F.col(f"_p_{n}") + F.col(f"_s_{n}") - F.col("_t") - F.least(F.col(f"_l_{n}"), F.col(f"_p_{n}") + F.col(f"_m_{n}"))
    return both.select(*calls.columns, F.greatest(F.lit(0), *(owed(n) - most for n, (_, most) in buckets.items())).alias("wait_us"))


def answered_once(place: str, key: str, made_by: str) -> Callable[[DataFrame, int], None]:
    """What a batch does so that each key is answered once: it appends the keys that no earlier batch has.

    Batch n reads the answers of batches below n only and overwrites its own, so one that is
    run again, after a failure at whatever point, writes the same.
    """

    def each(batch: DataFrame, n: int) -> None:
        first = batch.groupBy(key).agg(F.min(made_by).alias("made_by"))
        if n:
            first = first.join(answers(batch.sparkSession, place, key).where(F.col("batch") < n), key, "left_anti")
        first.write.mode("overwrite").parquet(f"{place}/batch={n}")

    return each


def answers(spark: SparkSession, place: str, key: str) -> DataFrame:
    """All stored answers: key, made_by, batch."""
    return spark.read.schema(f"{key} long, made_by long, batch int").parquet(place)


def once_only(calls: DataFrame, answered: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(calls to make, answers to replay) of a batch: the first call of a key that has no stored answer is made, all others are answered from it."""
    new = calls.join(answered.select(key), key, "left_anti").dropDuplicates([key])
    return new, calls.join(answered, key)


def stale(claims: DataFrame, at: str, now: F.Column | str, after: str = "2 minutes") -> DataFrame:
    """Claims whose lease has run out."""
    moment = F.lit(now).cast("timestamp") if isinstance(now, str) else now
    return claims.where(F.col(at) + F.expr(f"INTERVAL {after}") <= moment)


def expired(rows: DataFrame, until: str, now: str) -> DataFrame:
    return rows.where(F.col(until) < F.lit(now).cast("timestamp"))
