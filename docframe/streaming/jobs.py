"""Streaming versions of the job-event operators. The inputs are streaming DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from docframe.operators.jobs import ERROR_TTL, PAGE_TIMEOUT, TERMINAL


def _micros(ts: pd.Series) -> pd.Series:
    return ts.astype("datetime64[us]").astype("int64")


def job_status_stream(events: DataFrame, timeout: float = PAGE_TIMEOUT, delay: str = "1 minute") -> DataFrame:
    """Outcome per operation, emitted once it can no longer change.

    ``events``: ``job_id, op_id, ts, kind, code`` with consecutive ``op_id`` per job. State is kept per
    operation, so a busy job spreads over tasks: the start of operation k is also sent to k - 1 as
    ``supersede``. An operation closes when the watermark passes start + ``timeout``; at that point
    the earliest of terminal event, next start and deadline decides, as in the batch version. Terminal
    events wait in the state until then, because the start they must follow may arrive after them.
    """
    limit = int(timeout * 1_000_000)
    copies = F.when(
        F.col("kind") == "start",
        F.array(
            F.struct(F.col("op_id"), F.col("kind")),
            F.struct((F.col("op_id") - 1).alias("op_id"), F.lit("supersede").alias("kind")),
        ),
    ).otherwise(F.array(F.struct(F.col("op_id"), F.col("kind"))))
    routed = (
        events.withWatermark("ts", delay)
        .withColumn("__c", F.explode(copies))
        .select("job_id", F.col("__c.op_id").alias("op_id"), "ts", F.col("__c.kind").alias("kind"), "code")
        .filter(F.col("kind").isin("start", "supersede", *TERMINAL))
    )
    out = "job_id long, op_id long, start_ts timestamp, outcome string, code string, end_ts timestamp"
    state = "start long, next long, done array<long>, kinds array<string>, codes array<string>"

    def close(key: tuple, s: tuple) -> Iterator[pd.DataFrame]:
        start, nxt, *ends = s
        if start is None:
            return
        after = [e for e in zip(*ends, strict=True) if e[0] >= start]
        done, kind, code = min(after, key=lambda e: e[:2]) if after else (None, None, None)
        in_time = done is not None and done <= start + limit
        end = done if in_time else start + limit
        if nxt is not None and nxt < end:
            outcome, code, end = "superseded", None, nxt
        elif in_time:
            outcome = kind
        else:
            outcome, code = "timeout", None
        yield pd.DataFrame(
            {
                "job_id": [key[0]],
                "op_id": [key[1]],
                "start_ts": [pd.Timestamp(start, unit="us")],
                "outcome": [outcome],
                "code": [code],
                "end_ts": [pd.Timestamp(end, unit="us")],
            }
        )

    def step(key: tuple, batches: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        if group.hasTimedOut:
            kept = group.get
            group.remove()
            yield from close(key, kept)
            return
        start, nxt, *ends = group.get if group.exists else (None, None, [], [], [])
        done, kinds, codes = (list(x) for x in ends)
        latest = 0
        for pdf in batches:
            pdf = pdf.assign(us=_micros(pdf["ts"]))
            latest = max(latest, int(pdf["us"].max()))
            begun = pdf.loc[pdf["kind"] == "start", "us"]
            if len(begun):
                start = min(int(begun.min()), start if start is not None else int(begun.min()))
            later = pdf.loc[pdf["kind"] == "supersede", "us"]
            if len(later):
                nxt = min(int(later.min()), nxt if nxt is not None else int(later.min()))
            ended = pdf[pdf["kind"].isin(TERMINAL)]
            done += [int(us) for us in ended["us"]]
            kinds += list(ended["kind"])
            codes += [None if pd.isna(c) else c for c in ended["code"]]
        group.update((start, nxt, done, kinds, codes))
        due = ((start if start is not None else latest) + limit) // 1000 + 1
        group.setTimeoutTimestamp(max(due, group.getCurrentWatermarkMs() + 1))
        yield from ()

    return routed.groupBy("job_id", "op_id").applyInPandasWithState(
        step, out, state, "append", GroupStateTimeout.EventTimeTimeout
    )


class _Attach(StatefulProcessor):
    """One source and time bucket: waits for the watermark, then one ordered pass over the bucket's events.

    State: the events of the bucket, appended as they come, and the last event of the bucket before.
    """

    def __init__(self, width: int):
        self.width = width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", "us long, side int, id long, message string")
        self.before = handle.getValueState("before", "us long, side int, id long, message string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        last = tuple(self.before.get()) if self.before.exists() else None
        for pdf in rows:
            messages = [None if pd.isna(m) else m for m in pdf["message"]]
            found = list(zip(pdf["own"], pdf["us"].astype(int), pdf["side"].astype(int), pdf["id"].astype(int), messages, strict=True))
            own = [e[1:] for e in found if e[0]]
            if own:
                self.events.appendList([tuple(e) for e in own])
            carried = [e[1:] for e in found if not e[0]]
            last = max([*carried, *([last] if last else [])], key=lambda e: e[:3], default=None)
        if last:
            self.before.update(last)
        self.handle.registerTimer((key[1] + 1) * self.width // 1000 + 1)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        own = sorted((tuple(e) for e in self.events.get()), key=lambda e: e[:3])
        last = tuple(self.before.get()) if self.before.exists() else None
        out = []
        for e in own:
            us, side, name, _ = e
            if side:
                taken = last is not None and last[1] == 0 and us - last[0] <= self.width
                out.append((key[0], name, pd.Timestamp(us, unit="us"), last[2] if taken else None, last[3] if taken else None))
            last = e
        self.events.clear()
        self.before.clear()
        self.handle.deleteTimer(expiredTimerInfo.getExpiryTimeInMs())
        if out:
            frame = pd.DataFrame(out, columns=["source", "response_id", "ts", "error_id", "message"])
            yield frame.astype({"error_id": "Int64"})

    def close(self) -> None:
        pass


def attach_error_stream(
    responses: DataFrame, errors: DataFrame, ttl: float = ERROR_TTL, delay: str = "1 minute"
) -> DataFrame:
    """Give each response the latest error of its ``source`` within ``ttl`` seconds, once, as the batch version.

    Emitted once the watermark passes the response. State is kept per source and time bucket of ``ttl`` seconds, so a
    busy source spreads over tasks: events are sorted once per bucket, and every event is also sent to the next bucket,
    which keeps only the latest of them. Append mode; needs the RocksDB state store
    (``spark.sql.streaming.stateStore.providerClass``).
    """
    width = max(1, int(ttl * 1_000_000))
    event = ["source", "ts", "side", "id", "message"]
    r = responses.select(
        "source", "ts", F.lit(1).alias("side"), F.col("response_id").cast("long").alias("id"), F.lit(None).cast("string").alias("message")
    ).withWatermark("ts", delay)
    e = errors.select("source", "ts", F.lit(0).alias("side"), F.col("error_id").cast("long").alias("id"), "message").withWatermark("ts", delay)
    at = F.floor(F.unix_micros("ts") / F.lit(width))
    copies = F.array(F.struct(at.alias("bucket"), F.lit(True).alias("own")), F.struct((at + 1).alias("bucket"), F.lit(False).alias("own")))
    routed = r.unionByName(e).withColumn("c", F.explode(copies)).select(*event, F.unix_micros("ts").alias("us"), "c.bucket", "c.own")
    out = T.StructType(
        [
            T.StructField("source", responses.schema["source"].dataType), T.StructField("response_id", T.LongType()),
            T.StructField("ts", T.TimestampType()), T.StructField("error_id", T.LongType()), T.StructField("message", T.StringType()),
        ]
    )
    return routed.groupBy("source", "bucket").transformWithStateInPandas(_Attach(width), out, "append", "EventTime")


class _Progress(StatefulProcessor):
    """Latest progress of one job, forgotten when the job has been quiet for ``quiet`` milliseconds of event time."""

    def __init__(self, quiet: int):
        self.quiet = quiet

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", "us long, event_id long, completed long")

    def _due(self, us: int) -> int:
        return us // 1000 + self.quiet

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        known = tuple(self.latest.get()) if self.latest.exists() else None
        best = known
        for pdf in rows:
            top = pdf.sort_values(["us", "event_id"]).iloc[-1]
            one = (int(top["us"]), int(top["event_id"]), None if pd.isna(top["completed"]) else int(top["completed"]))
            best = one if best is None or one[:2] > best[:2] else best
        if best == known:
            return
        if known is not None:
            self.handle.deleteTimer(self._due(known[0]))
        self.latest.update(best)
        self.handle.registerTimer(self._due(best[0]))
        frame = pd.DataFrame([(key[0], pd.Timestamp(best[0], unit="us"), best[2])], columns=["job_id", "ts", "completed"])
        yield frame.astype({"completed": "Int64"})

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.latest.clear()
        self.handle.deleteTimer(expiredTimerInfo.getExpiryTimeInMs())
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def job_progress_stream(events: DataFrame, delay: str = "1 minute", quiet: float = PAGE_TIMEOUT) -> DataFrame:
    """Latest progress per job; run in update mode.

    A job's state is dropped once the watermark is ``quiet`` seconds past its last progress, so the state holds running
    jobs only. Needs the RocksDB state store, as :func:`attach_error_stream`.
    """
    out = T.StructType(
        [
            T.StructField("job_id", events.schema["job_id"].dataType), T.StructField("ts", T.TimestampType()),
            T.StructField("completed", T.LongType()),
        ]
    )
    rows = (
        events.withWatermark("ts", delay).filter("kind = 'progress' AND ts IS NOT NULL")
        .select("job_id", "ts", F.unix_micros("ts").alias("us"), F.col("event_id").cast("long").alias("event_id"), F.col("completed").cast("long").alias("completed"))
    )
    return rows.groupBy("job_id").transformWithStateInPandas(_Progress(int(quiet * 1000)), out, "update", "EventTime")
