"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL_DEFAULT = "/tmp/checkpoints"
_made: list[tuple[object, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). Where it is unset, a local default on a
    local master, and an error on a cluster, whose machines share no local folder."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        folder = LOCAL_DEFAULT
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark)}/corpusloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    _made.append((spark, path))
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost
    executors, and gives later joins a measured size to choose a strategy from."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._stored_at = path
    return stored


def spread(df: DataFrame) -> DataFrame:
    """df dealt to as many partitions as the session has cores, where it is a plain scan of fewer
    (a file of one row group is one task), for what costs far more than reading; else as it is.
    Large tables have more partitions than cores, so nothing is exchanged there."""
    if df.isStreaming:
        return df
    plan = df._jdf.queryExecution().executedPlan()
    if "Exchange" in plan.toString():
        return df
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if plan.execute().getNumPartitions() < n else df


def discard(df: DataFrame) -> None:
    """Remove a table that materialize() stored, once nothing reads it any more."""
    path = df._stored_at
    remove(df.sparkSession, path)
    _made[:] = [x for x in _made if x[1] != path]


def stored_bytes(df: DataFrame) -> int:
    """The bytes that a table takes which materialize() stored."""
    system, at = _hadoop(df.sparkSession, df._stored_at)
    return system.getContentSummary(at).getLength()


def replace(spark: SparkSession, new: str, path: str) -> None:
    """Put the folder new in the place of path by renaming, so that a reader sees the old state
    or the new one; what was there is removed after. A crash between the two renames leaves the
    old state under path.old, which restore() puts back."""
    system, at = _hadoop(spark, path)
    _, old = _hadoop(spark, f"{path}.old")
    _, fresh = _hadoop(spark, new)
    restore(spark, path)
    if system.exists(at):
        system.rename(at, old)
    system.rename(fresh, at)
    system.delete(old, True)


def restore(spark: SparkSession, path: str) -> None:
    """Undo a replacement that was cut off, if there is one."""
    system, at = _hadoop(spark, path)
    _, old = _hadoop(spark, f"{path}.old")
    if system.exists(old):
        if system.exists(at):
            system.delete(old, True)
        else:
            system.rename(old, at)


def _hadoop(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def copy_file(spark: SparkSession, source: str, target: str) -> None:
    """Copy one file between stores."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    (a, x), (b, y) = _hadoop(spark, source), _hadoop(spark, target)
    spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.copy(a, x, b, y, False, True, conf)


def path_exists(spark: SparkSession, path: str) -> bool:
    system, at = _hadoop(spark, path)
    return system.exists(at)


def remove(spark: SparkSession, path: str) -> None:
    system, at = _hadoop(spark, path)
    system.delete(at, True)


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            remove(spark, path)
        except Exception:  # the session may be gone already
            pass
