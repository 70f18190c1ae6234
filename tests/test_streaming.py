from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from orospark.operators.progress import throttled
from orospark.sources.sinks import append_events
from orospark.streaming import jobs

START = datetime(2024, 6, 1)


@pytest.fixture
def run(spark, tmp_path):
    def go(make, rows, schema, parts=3, mode="append"):
        src, n = f"file://{tmp_path}/in", 0
        got: dict = {}
        step = -(-len(rows) // parts)
        for k in range(0, len(rows), step):
            append_events(spark.createDataFrame(rows[k : k + step], schema).coalesce(1), src)
            stream = make(jobs.read_changes(spark, src, schema))
            n += 1

            def take(df, _):
                got.setdefault("rows", []).extend(df.collect())

            q = stream.writeStream.foreachBatch(take).outputMode(mode).option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
            q.awaitTermination(120)
        return got.get("rows", [])

    return go


def test_streaming_throttle_matches_the_batch_fold(spark, run):
    rows = [(f"j{k % 3}", START + timedelta(seconds=k * 0.4), k % 7 * 0.3) for k in range(60)]
    got = run(jobs.throttle, rows, "job_id string, ts timestamp, percent double")
    e = spark.createDataFrame(rows, "job_id string, ts timestamp, percent double").withColumn("s", F.unix_micros("ts") / 1e6)
    want = {r.job_id: r.emissions for r in throttled(e, "job_id", "s", "percent", ["ts"]).collect()}
    assert {j: sum(r.job_id == j for r in got) for j in want} == want


def test_latest_documents(run):
    rows = [("a", START, 1, "queued", 0.0), ("b", START, 2, "queued", 0.0), ("a", START, 3, "tiling", 30.0), ("a", START, 4, "completed", 100.0)]
    got = run(jobs.latest_documents, rows, "job_id string, ts timestamp, seq long, status string, percent double", 2, "update")
    last = {}
    for r in got:
        last[r.job_id] = (r.status, r.percent)
    assert last == {"a": ("completed", 100.0), "b": ("queued", 0.0)}


def test_documents_expire_a_week_after_their_last_change(run):
    day = timedelta(days=1)
    rows = [("a", START, 9, "tiling", 30.0), ("b", START, 1, "queued", 0.0), ("b", START + 6 * day, 2, "tiling", 5.0), ("z", START + 9 * day, 1, "queued", 0.0), ("z", START + 9 * day, 2, "queued", 0.0), ("a", START + 9 * day, 3, "running", 1.0), ("b", START + 9 * day, 1, "old", 0.0)]
    got = run(jobs.latest_documents, rows, "job_id string, ts timestamp, seq long, status string, percent double", 7, "update")
    last = {r.job_id: r.status for r in got}
    assert last == {"a": "running", "b": "tiling", "z": "queued"}  # a's state was gone, so an earlier number counts; b's wasn't


def test_following_a_job(spark, tmp_path):
    import threading

    path, schema = f"file://{tmp_path}/log", "job_id string, seq long, status string"
    add = lambda *rows: append_events(spark.createDataFrame(list(rows), schema).coalesce(1), path)
    add(("a", 1, "queued"), ("a", 2, "running"), ("b", 1, "completed"))
    got = []
    late = threading.Timer(3, lambda: (add(("a", 3, "tiling"), ("b", 2, "x")), add(("a", 4, "completed"), ("a", 5, "behind the end"))))
    late.start()
    assert jobs.follow(spark, path, schema, "a", lambda r: got.append((r.seq, r.status)), seconds=90)
    late.join()
    assert got == [(2, "running"), (3, "tiling"), (4, "completed")]
    over = []
    assert jobs.follow(spark, path, schema, "b", over.append, seconds=5) is False and [r.seq for r in over] == [2]
    assert jobs.follow(spark, path, schema, "a", over.append, seconds=5) is False and over[-1].seq == 5
    add(("c", 1, "failed"))
    assert jobs.follow(spark, path, schema, "c", over.append) and over[-1].status == "failed"


def test_subscription_ends_with_the_job(run):
    rows = [("a", START, "queued"), ("b", START, "failed"), ("a", START, "completed")]
    got = run(lambda s: jobs.until_terminal(s, "a"), rows, "job_id string, ts timestamp, status string", 1)
    assert [(r.status, r.is_last) for r in got] == [("queued", False), ("completed", True)]


def test_log_percent_across_chunks(run):
    chunks = ["0...1", "0...2", "0...", "garbage", "5", "5.5%", " 100 - do", "ne."]
    rows = [("a", START + timedelta(seconds=k), k, c) for k, c in enumerate(chunks)]
    got = run(jobs.log_percent, rows, "job_id string, ts timestamp, seq long, text string", 4)
    by = {r.seq: r.percent for r in got}
    assert by[0] == 1.0 and by[1] == 10.0 and by[2] == 20.0 and by[3] == 20.0 and by[5] == 55.5 and by[7] == 100.0
    assert [by[k] for k in sorted(by)] == sorted(by.values())
