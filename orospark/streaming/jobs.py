"""Streaming views of job change logs."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from orospark.operators.progress import MIN_POINTS, MIN_SECONDS

TTL_MILLIS = 604_800_000
TERMINAL = ("completed", "failed")


def read_changes(spark: SparkSession, path: str, schema: str, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Changes appended to a folder; ts becomes an event time with a watermark."""
    return spark.readStream.schema(schema).parquet(path).withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def throttle(changes: DataFrame, job: str = "job_id", ts: str = "ts", percent: str = "percent", min_seconds: float = MIN_SECONDS, min_points: float = MIN_POINTS, ttl_millis: int = TTL_MILLIS) -> DataFrame:
    """(job, ts, percent): updates that move by min_points or come min_seconds after the last let through.

    State is two numbers a job, dropped a week after its last update."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last_s, last_p = state.get if state.exists else (None, -1.0)
        rows = pd.concat(list(batches)).sort_values([ts, percent], kind="stable")
        out = []
        for s, p in zip(rows[ts].astype("int64") / _unit(rows[ts]), rows[percent], strict=True):
            out.append(last_s is None or s - last_s >= min_seconds or abs(p - last_p) >= min_points)
            if out[-1]:
                last_s, last_p = float(s), float(p)
        if last_s is not None:
            state.update((last_s, last_p))
        state.setTimeoutTimestamp(max(int(rows[ts].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + ttl_millis)
        kept = rows[out]
        yield pd.DataFrame({job: key[0], ts: kept[ts], percent: kept[percent].astype(float)})

    schema = f"{job} {dict(changes.dtypes)[job]}, {ts} timestamp, {percent} double"
    return changes.groupBy(job).applyInPandasWithState(step, schema, "s double, p double", "append", GroupStateTimeout.EventTimeTimeout)


def _unit(s: pd.Series) -> float:
    return {"s": 1.0, "ms": 1e3, "us": 1e6, "ns": 1e9}[getattr(s.dt, "unit", "ns")]


def latest_documents(changes: DataFrame, job: str = "job_id", order: str = "seq", columns: tuple[str, ...] = ("status", "percent"), ts: str = "ts", ttl_millis: int = TTL_MILLIS) -> DataFrame:
    """The current document of each job, as it changes (update mode). State is one document a job, dropped a week after its last
    change: each change sets the clock back."""
    types = dict(changes.dtypes)
    names = [order, *columns]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches))
        best = rows.loc[rows[order].idxmax(), names].tolist()
        if not state.exists or best[0] >= state.get[0]:
            state.update(tuple(x.item() if hasattr(x, "item") else x for x in best))
        state.setTimeoutTimestamp(max(int(rows[ts].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + ttl_millis)
        yield pd.DataFrame([[key[0], *state.get[1:]]], columns=[job, *columns])

    schema = ", ".join(f"{c} {types[c]}" for c in (job, *columns))
    return changes.select(job, ts, *names).groupBy(job).applyInPandasWithState(step, schema, ", ".join(f"{c} {types[c]}" for c in names), "update", GroupStateTimeout.EventTimeTimeout)


def until_terminal(changes: DataFrame, job_id, job: str = "job_id") -> DataFrame:
    """What a subscriber of one job sees; it is over when a row is_last comes. See follow() for a subscription that ends."""
    return changes.where(F.col(job) == job_id).withColumn("is_last", F.col("status").isin(*TERMINAL))


def follow(spark: SparkSession, path: str, schema: str, job_id, send: Callable[[Row], None], job: str = "job_id", order: str = "seq", every: str = "500 milliseconds", seconds: float | None = None) -> bool:
    """Send one job's current state, then each change as it is appended, until a terminal one has been sent or the time is over.

    Nothing is sent twice, nor behind what was sent: the stream starts from the snapshot's order. Returns whether the job
    ended. One job's changes reach the driver, as a subscriber's do; others don't."""
    log = spark.read.schema(schema).parquet(path).where(F.col(job) == job_id)
    now = log.orderBy(F.desc(order)).limit(1).collect()
    sent = [now[0][order] if now else None]
    if now:
        send(now[0])
        if now[0].status in TERMINAL:
            return True
    over = threading.Event()

    def take(rows: DataFrame, _: int) -> None:
        for r in rows.orderBy(order).collect():
            if not over.is_set() and (sent[0] is None or r[order] > sent[0]):
                sent[0] = r[order]
                send(r)
                if r.status in TERMINAL:
                    over.set()

    fresh = spark.readStream.schema(schema).parquet(path).where(F.col(job) == job_id)
    query = fresh.writeStream.foreachBatch(take).trigger(processingTime=every).start()
    began = time.monotonic()
    try:
        while query.isActive and not over.wait(0.05) and (seconds is None or time.monotonic() - began < seconds):
            pass
    finally:
        query.stop()
    return over.is_set()


def log_percent(chunks: DataFrame, job: str = "job_id", seq: str = "seq", text: str = "text", ts: str = "ts", window: int = 512, ttl_millis: int = TTL_MILLIS) -> DataFrame:
    """(job, seq, percent) after each chunk of a job's log. Numbers cut in two by a chunk's end are still read: state is
    the last ``window`` characters and the highest percent."""
    import re

    from orospark.functions import progress as P

    dot, per, done = re.compile(P.DOT_STEP), re.compile(P.PERCENT), re.compile(P.DONE)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tail, best = state.get if state.exists else ("", 0.0)
        rows = pd.concat(list(batches)).sort_values(seq, kind="stable")
        out = []
        for chunk in rows[text].fillna(""):
            tail = (tail + chunk)[-window:]
            found = [float(m[1]) for p in (dot, per) for m in p.finditer(tail)]
            best = 100.0 if done.search(tail) or "100 - done" in tail.lower() else min(100.0, max([best, *found]))
            out.append(best)
        state.update((tail, best))
        state.setTimeoutTimestamp(max(int(rows[ts].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + ttl_millis)
        yield pd.DataFrame({job: key[0], seq: rows[seq].to_numpy(), "percent": out})

    schema = f"{job} {dict(chunks.dtypes)[job]}, {seq} long, percent double"
    return chunks.groupBy(job).applyInPandasWithState(step, schema, "tail string, best double", "append", GroupStateTimeout.EventTimeTimeout)
