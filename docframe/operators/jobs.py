"""Job-event operators: outcome of an operation, error attachment and progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docframe.plans.scan import bucket_of, ordered_scan, time_bucket

# Reference timeouts in seconds.
PAGE_TIMEOUT = 15 * 60
ERROR_TTL = 5.0

TERMINAL = ("success", "error", "cancel")


def seconds(n: float) -> Column:
    """An interval of ``n`` seconds."""
    return F.expr(f"INTERVAL {float(n):.6f} SECOND")


def job_status(events: DataFrame, timeout: float = PAGE_TIMEOUT) -> DataFrame:
    """Outcome per operation: ``job_id, op_id, start_ts, outcome, code, end_ts``.

    ``events``: ``job_id, op_id, ts, kind, code``. The first terminal event from the start to
    start + ``timeout`` decides; one stamped before the start is ignored. An operation whose job starts another one before that is
    ``superseded``; later events are ignored; no decision gives ``timeout``.
    """
    op = ["job_id", "op_id"]
    starts = events.filter("kind = 'start'").groupBy(op).agg(F.min("ts").alias("start_ts"))
    done = events.filter(F.col("kind").isin(*TERMINAL)).select(*op, F.struct("ts", "kind", "code").alias("end"))
    ends = done.join(starts, op).filter("end.ts >= start_ts").groupBy(op).agg(F.min("end").alias("end"))
    ops = starts.join(ends, op, "left")
    after = ordered_scan(ops, ["job_id"], ["op_id"], bucket_of("op_id"), lead={"next_start": F.col("start_ts")})
    deadline = F.col("start_ts") + seconds(timeout)
    in_time = F.col("end.ts") <= deadline
    limit = F.when(in_time, F.col("end.ts")).otherwise(deadline)
    superseded = F.coalesce(F.col("next_start") < limit, F.lit(False))
    outcome = (
        F.when(superseded, F.lit("superseded")).when(in_time, F.col("end.kind")).otherwise(F.lit("timeout"))
    )
    return after.select(
        "job_id",
        "op_id",
        "start_ts",
        outcome.alias("outcome"),
        F.when(~superseded & in_time, F.col("end.code")).alias("code"),
        F.when(superseded, F.col("next_start")).otherwise(limit).alias("end_ts"),
    )


def attach_error(responses: DataFrame, errors: DataFrame, ttl: float = ERROR_TTL, bucket_seconds: int = 3600) -> DataFrame:
    """Give each response the latest error of its ``source`` within ``ttl`` seconds, once.

    A newer error replaces an older one and the first response after an error takes it, so a
    response receives an error exactly when its direct predecessor in time order is that error.
    ``responses``: ``source, response_id, ts``; ``errors``: ``source, error_id, ts, message``.
    """
    r = responses.select(
        "source", "ts", F.lit(1).alias("side"), F.col("response_id").alias("id"), F.lit(None).cast("string").alias("message")
    )
    e = errors.select("source", "ts", F.lit(0).alias("side"), F.col("error_id").alias("id"), "message")
    seen = ordered_scan(
        r.unionByName(e), ["source"], ["ts", "side", "id"], time_bucket("ts", bucket_seconds),
        lag={"p": F.struct("ts", "side", "id", "message")},
    ).filter("side = 1")
    taken = F.coalesce((F.col("p.side") == 0) & (F.col("ts") - F.col("p.ts") <= seconds(ttl)), F.lit(False))
    return seen.select(
        "source",
        F.col("id").alias("response_id"),
        "ts",
        F.when(taken, F.col("p.id")).alias("error_id"),
        F.when(taken, F.col("p.message")).alias("message"),
    )


def job_progress(events: DataFrame) -> DataFrame:
    """Latest progress per job: ``job_id, ts, completed``."""
    return (
        events.filter("kind = 'progress'")
        .groupBy("job_id")
        .agg(F.max(F.struct("ts", "event_id", "completed")).alias("p"))
        .select("job_id", F.col("p.ts").alias("ts"), F.col("p.completed").alias("completed"))
    )
