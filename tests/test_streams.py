"""What a stream's batches write when one is run again, and bucket waits against a plain replay."""

import datetime as dt
import random

from pyspark.sql import functions as F

from ledgerlight.streaming import feeds


def test_a_batch_run_again_keeps_its_claims(spark, tmp_path):
    place = str(tmp_path / "answers")
    each = feeds.answered_once(place, "k", "event_id")
    batches = [spark.createDataFrame(rows, "event_id long, k long") for rows in ([(1, 7), (2, 8), (3, 7)], [(4, 8), (5, 9)], [(6, 9), (7, 10)])]
    for n, b in enumerate(batches):
        each(b, n)
        each(b, n)  # as after a failure between the write and the commit
    each(batches[1], 1)
    assert sorted((r.k, r.made_by) for r in feeds.answers(spark, place, "k").collect()) == [(7, 1), (8, 2), (9, 5), (10, 7)]


def test_bucket_waits(spark):
    rnd = random.Random(1)
    start = dt.datetime(2024, 1, 1)
    rows = [(i, i % 3, start + dt.timedelta(seconds=rnd.randint(0, 4 * 86_400) if i % 3 else rnd.randint(0, 90_000)), rnd.randint(1, 40)) for i in range(300)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, cost long")
    buckets = {"one": (F.lit(1_000_000_000), 3_000_000_000), "two": (F.col("cost") * 50_000_000, 1_500_000_000)}
    got = {r.event_id: r.wait_us for r in feeds.bucket_waits(df, "user_id", "ts", "event_id", buckets).collect()}
    owed = {}
    for i, user, ts, cost in sorted(rows, key=lambda r: (r[2], r[0])):
        now, wait = int((ts - start).total_seconds() * 1e6), 0
        for name, own, most in (("one", 1_000_000_000, 3_000_000_000), ("two", min(cost * 50_000_000, 1_500_000_000), 1_500_000_000)):
            debt, at = owed.get((user, name), (0, now))
            debt = max(0, debt - (now - at)) + own
            owed[user, name] = debt, now
            wait = max(wait, debt - most)
        assert got[i] == wait, i
    assert any(got.values())


def loop_pages(batches, limit, overlap):
    """What a reader of pages gets when the log grows batch by batch and it reads to the end after each."""
    log, since, page, got, out = set(), 0, 0, set(), []
    for batch in batches:
        log.update(batch)
        while True:
            part = sorted(x for x in log if x > since)[:limit]
            new = [x for x in part if x not in got]
            if not new:
                break
            page += 1
            got.update(new)
            out += [(page, x) for x in new]
            since = max(since, part[-1] - overlap)
    return out


def test_pages_with_late_and_repeated_rows_and_a_restart(spark, tmp_path):
    import time

    rnd = random.Random(5)
    logs = {}
    for run in (1, 2):
        order = sorted(range(1, 260), key=lambda x: x + rnd.choice((0, 0, 5, 30, 90)))  # some come later than the overlap reaches
        logs[run] = [order[i : i + 60] + rnd.sample(order[: i + 1], min(i + 1, 9)) for i in range(0, len(order), 60)]
    log, out, state = (str(tmp_path / x) for x in ("log", "out", "state"))
    schema = "run long, seq long"
    got = None
    for n in range(len(logs[1])):
        rows = [(run, x) for run in logs for x in logs[run][n]] + [(None, 1), (1, None)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(log)
        time.sleep(0.05)
        stream = feeds.paged(feeds.log_stream(spark, log, spark.createDataFrame([], schema).schema), "run", "seq", limit=40, overlap=20)
        got = feeds.drain(stream, out, state)  # each batch a stream that starts anew from its state
    missed = 0
    for run in logs:
        want = loop_pages(logs[run], 40, 20)
        assert sorted((r.page, r.seq) for r in got.where(F.col("run") == run).collect()) == sorted(want)
        missed += 259 - len(want)
    assert missed > 0
