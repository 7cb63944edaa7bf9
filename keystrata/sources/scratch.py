"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Removes an execution's shuffle files when it ends; they would stay until the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, a local session gets a temporary folder; on a
    cluster that would be a different disk on each machine, so it raises."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        return d.rstrip("/")
    context = spark.sparkContext
    have = context._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return have.get().rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    context.setCheckpointDir(f"file://{tempfile.mkdtemp()}")
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: lineage ends here, and a lost executor
    costs no recomputation of what lies before. release() removes the files."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def release(*frames: DataFrame) -> None:
    """Deletes tables of materialize() that nothing reads any more."""
    for df in frames:
        spark, path = df.sparkSession, df._scratch_path
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextlib.contextmanager
def releasing():
    """Stores frames by keep(frame), if they aren't stored yet, and deletes all those tables at the end of the block."""
    held: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        held.append(df if "_scratch_path" in vars(df) else materialize(df))
        return held[-1]

    try:
        yield keep
    finally:
        release(*held)
