"""Materialised intermediate tables in the shared checkpoint folder.

A result that several branches of a plan read is written once as parquet, which cuts the lineage
and survives the loss of executors. The folder is ``spark.checkpoint.dir``, else the folder given to
``SparkContext.setCheckpointDir``. A session in one process (``local[n]``) that has neither gets a
temporary one; on a cluster that is an error, since executors do not share local folders.

Shuffle files of such a write are removed once it is complete. ``release`` removes a table that nothing
reads any more, as a loop does with the table of the round before.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def work_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables and streaming checkpoints."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    context = spark.sparkContext
    given = context._jsc.sc().getCheckpointDir()
    if given.isDefined():
        return given.get().rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = context.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="docframe-")
    return _OWN[app]


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path nobody has used yet."""
    return f"{work_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str = "stage", compression: str | None = None) -> DataFrame:
    """Write ``df`` once and read it back."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path, compression=compression)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    staged = spark.read.schema(df.schema).parquet(path)
    staged.staged_at = path
    return staged


def release(*staged: DataFrame) -> None:
    """Remove tables written by ``stage``; a result that still reads them can't be computed any more."""
    for df in staged:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df.staged_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
