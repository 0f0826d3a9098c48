"""Stage boundaries and files in the store that the session's executors share."""

from __future__ import annotations

import atexit
import json
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DEFAULT = "/tmp/linkwright-checkpoints"
_FREES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; on a local master a default where it is unset. A cluster without it raises."""
    if path := spark.conf.get("spark.checkpoint.dir", None):
        return path
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return _LOCAL_DEFAULT


def _folder(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def forget(spark: SparkSession, path: str) -> None:
    """Deletes a folder if it is there."""
    target, store = _folder(spark, path)
    store.delete(target, True)


def _forget_at_exit(spark: SparkSession, path: str) -> None:
    try:
        forget(spark, path)
    except Exception:  # the session may be gone; the folder is the cluster's to clean then
        pass


def folder_bytes(spark: SparkSession, path: str) -> int:
    """Bytes under a folder, 0 if it isn't there."""
    target, store = _folder(spark, path)
    return store.getContentSummary(target).getLength() if store.exists(target) else 0


def is_done(spark: SparkSession, path: str) -> bool:
    """Whether a write to the folder has been committed, so that a run can go on after it."""
    target, store = _folder(spark, f"{path}/_SUCCESS")
    return store.exists(target)


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder's name in the shared store; it goes when the process ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    atexit.register(_forget_at_exit, spark, path)
    return path


@contextmanager
def shuffles_freed(spark: SparkSession):
    """The shuffle files of a query that runs inside go when it ends; else they stay until the driver collects its garbage."""
    before = spark.conf.get(_FREES, None)
    spark.conf.set(_FREES, "true")
    try:
        yield
    finally:
        spark.conf.set(_FREES, before) if before is not None else spark.conf.unset(_FREES)


def staged(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write df as Parquet to the shared folder and read it back; what it shuffled goes from the disks.

    A lost executor cannot lose the rows, unlike those of a local checkpoint. The folder goes when the process ends, or
    sooner by released().
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    with shuffles_freed(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def released(df: DataFrame) -> None:
    """Deletes the folder behind a staged frame that nothing reads any more."""
    if path := getattr(df, "_staged_path", None):
        _forget_at_exit(df.sparkSession, path)


def resumed(df: DataFrame, path: str) -> DataFrame:
    """df through a stage folder of a given name: written unless a former run has committed it."""
    spark = df.sparkSession
    if not is_done(spark, path):
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def save_json(spark: SparkSession, value: dict, path: str) -> None:
    """One JSON document as a text folder in any store that Spark reaches."""
    text = json.dumps(value, ensure_ascii=False, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def log_line(spark: SparkSession, value: dict, path: str) -> None:
    """Adds one JSON line to a log folder."""
    spark.createDataFrame([(json.dumps(value, ensure_ascii=False, sort_keys=True),)], "value string").coalesce(1).write.mode("append").text(path)


def read_log(spark: SparkSession, path: str) -> list[dict]:
    """The log's records; a log holds one for each experiment."""
    return [json.loads(r[0]) for r in spark.read.text(path).collect()]
