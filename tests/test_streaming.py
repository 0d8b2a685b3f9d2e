"""Streaming operators against their batch twins, over a file source drained with availableNow."""

import time

import pytest
from pyspark.sql import functions as F

from docframe.operators import jobs as J
from docframe.plans.stage import fresh_path
from docframe.sources.fixtures import Fixtures
from docframe.streaming import jobs as SJ

SF = "/root/testdata/sf0.001"


def as_files(df, label, parts=3):
    """Write ``df`` as time-ordered files one after another, so that micro-batches arrive in order."""
    path = fresh_path(df.sparkSession, label)
    lo, hi = df.agg(F.min("ts"), F.max("ts")).first()
    for k in range(parts):
        low, high = lo + (hi - lo) * k / parts, lo + (hi - lo) * (k + 1) / parts
        end = F.col("ts") <= high if k == parts - 1 else F.col("ts") < high
        df.filter((F.col("ts") >= low) & end).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    return path


def stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def drain(df, name, mode):
    spark = df.sparkSession
    q = (
        df.writeStream.format("memory").queryName(name).outputMode(mode)
        .option("checkpointLocation", fresh_path(spark, "ckpt")).trigger(availableNow=True).start()
    )
    q.awaitTermination(180)
    if q.exception():
        raise AssertionError(str(q.exception()))
    # Read the sink like a stored table; the in-memory relation cannot be joined to itself.
    sink = spark.table(name)
    return spark.createDataFrame(sink.collect(), sink.schema)


@pytest.fixture(scope="module")
def events(spark):
    ev = Fixtures(spark, SF).job_events().withColumn("ts", F.col("ts").cast("timestamp"))
    return spark.createDataFrame(ev.collect(), ev.schema)


def test_job_status_stream_matches_batch(spark, events):
    timeout = 36_000
    # A last event far in the future moves the watermark past every deadline.
    flush = spark.sql(
        "SELECT CAST(-1 AS BIGINT) job_id, CAST(-1 AS BIGINT) event_id, TIMESTAMP'2030-01-01' ts, 'success' kind,"
        " CAST(NULL AS STRING) code, CAST(0 AS BIGINT) completed, CAST(1 AS BIGINT) op_id"
    ).select(*events.columns)
    more = flush.withColumn("ts", F.expr("TIMESTAMP'2031-01-01'"))
    path = as_files(events, "ev")
    flush.write.mode("append").parquet(path)
    more.write.mode("append").parquet(path)
    out = drain(SJ.job_status_stream(stream(spark, path, events.schema), timeout), "job_status_out", "append")
    cols = ["job_id", "op_id", "start_ts", "outcome", "code", "end_ts"]
    got = sorted(map(str, out.select(*cols).collect()))
    want = sorted(map(str, J.job_status(events, timeout).select(*cols).collect()))
    assert got == want and len(got) > 50


@pytest.fixture
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(key, before)


def attached(spark, r, e, ttl, name):
    """The stream's result; two late rows per side move the watermark past every response."""
    r_path, e_path = as_files(r, "resp"), as_files(e, "err")
    for year in ("2030", "2031"):
        spark.sql(f"SELECT CAST(-1 AS BIGINT) source, CAST(-{year} AS BIGINT) response_id, TIMESTAMP'{year}-01-01' ts").write.mode("append").parquet(r_path)
        spark.sql(f"SELECT CAST(-2 AS BIGINT) source, CAST(-{year} AS BIGINT) error_id, TIMESTAMP'{year}-01-01' ts, 'x' message").write.mode("append").parquet(e_path)
        time.sleep(1.1)
    out = drain(SJ.attach_error_stream(stream(spark, r_path, r.schema), stream(spark, e_path, e.schema), ttl), name, "append")
    return out.filter("source >= 0")


_ATTACHED = ["source", "response_id", "ts", "error_id", "message"]


def test_attach_error_stream_matches_batch(spark, rocksdb):
    f = Fixtures(spark, SF)
    ttl = 14_400
    r = f.responses().withColumn("ts", F.col("ts").cast("timestamp"))
    e = f.errors().withColumn("ts", F.col("ts").cast("timestamp"))
    got = attached(spark, r, e, ttl, "attached_out").select(*_ATTACHED)
    want = J.attach_error(r, e, ttl).select(*_ATTACHED)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert want.filter("error_id IS NOT NULL").count() > 5


def test_an_error_is_taken_once_across_buckets(spark, rocksdb):
    """One source; ties, errors just before a bucket's end, repeated errors and two responses to one error."""
    at = "2024-01-01 00:00:{:06.3f}".format
    errors = [(1, 1, at(4.9), "a"), (1, 2, at(9.0), "b"), (1, 3, at(9.5), None), (1, 4, at(20.0), "d"), (1, 5, at(30.0), "e"), (2, 6, at(5.0), "f")]
    responses = [(1, 1, at(5.1)), (1, 2, at(5.2)), (1, 3, at(12.0)), (1, 4, at(25.0)), (1, 5, at(25.0)), (1, 6, at(35.001)), (2, 7, at(5.0))]
    e = spark.createDataFrame(errors, "source long, error_id long, ts string, message string").withColumn("ts", F.col("ts").cast("timestamp"))
    r = spark.createDataFrame(responses, "source long, response_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = attached(spark, r, e, 5.0, "once_out").select(*_ATTACHED).collect()
    assert {x.response_id: x.error_id for x in got} == {1: 1, 2: None, 3: 3, 4: 4, 5: None, 6: None, 7: 6}
    assert sorted(map(str, got)) == sorted(map(str, J.attach_error(r, e, 5.0).select(*_ATTACHED).collect()))


def test_job_progress_stream_matches_batch(spark, events, rocksdb):
    path = as_files(events, "prog")
    late = events.filter("kind = 'progress'").limit(1).withColumn("job_id", F.lit(-1).cast("long"))
    for year in (2030, 2031):
        late.withColumn("ts", F.expr(f"TIMESTAMP'{year}-01-01'")).select(*events.columns).write.mode("append").parquet(path)
        time.sleep(1.1)
    df = SJ.job_progress_stream(stream(spark, path, events.schema), quiet=86_400)
    q = (
        df.writeStream.format("memory").queryName("progress_out").outputMode("update")
        .option("checkpointLocation", fresh_path(spark, "ckpt")).trigger(availableNow=True).start()
    )
    q.awaitTermination(180)
    assert q.exception() is None
    seen = [p.stateOperators[0].numRowsTotal for p in q.recentProgress if p.stateOperators]
    sink = spark.table("progress_out")
    out = spark.createDataFrame(sink.collect(), sink.schema).filter("job_id >= 0")
    latest = out.groupBy("job_id").agg(F.max(F.struct("ts", "completed")).alias("p")).select("job_id", "p.*")
    assert sorted(map(str, latest.collect())) == sorted(map(str, J.job_progress(events).select("job_id", "ts", "completed").collect()))
    # Only the late job is left; the state of all others is gone.
    assert max(seen) > seen[-1] and seen[-1] <= 2, seen


def test_terminal_before_the_start_is_ignored(spark):
    """Operation 1 ended before it began and again after; operation 2 of another job only before."""
    rows = [
        (1, 1, "2024-01-01 00:00:00", "success", None), (1, 1, "2024-01-01 00:10:00", "start", None),
        (1, 1, "2024-01-01 00:11:00", "error", "code-1"), (2, 2, "2024-01-01 00:05:00", "cancel", None),
        (2, 2, "2024-01-01 00:06:00", "start", None),
    ]
    schema = "job_id long, op_id long, ts string, kind string, code string"
    events = spark.createDataFrame(rows, schema).withColumn("ts", F.col("ts").cast("timestamp"))
    late = [(-1, 1, f"20{y}-01-01 00:00:00", "success", None) for y in (30, 31)]
    late = spark.createDataFrame(late, schema).withColumn("ts", F.col("ts").cast("timestamp"))
    cols = ["job_id", "op_id", "outcome", "code", F.unix_micros("end_ts").alias("end_us")]
    want = sorted(map(str, J.job_status(events).select(*cols).collect()))
    ends = spark.sql("SELECT unix_micros(TIMESTAMP'2024-01-01 00:11:00') AS a, unix_micros(TIMESTAMP'2024-01-01 00:21:00') AS b").first()
    assert want == [
        f"Row(job_id=1, op_id=1, outcome='error', code='code-1', end_us={ends['a']})",
        f"Row(job_id=2, op_id=2, outcome='timeout', code=None, end_us={ends['b']})",
    ]
    path = as_files(events, "early", parts=2)
    for k in range(2):
        late.filter(F.year("ts") == 2030 + k).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    out = drain(SJ.job_status_stream(stream(spark, path, events.schema)), "early_terminal_out", "append")
    assert sorted(map(str, out.select(*cols).collect())) == want
