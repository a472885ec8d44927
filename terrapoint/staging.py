"""Intermediate tables in the folder that the cluster shares (spark.checkpoint.dir)."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from terrapoint.types import ConfigError


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; one of our own only where the setting is missing and all tasks run in this process."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ConfigError("spark.checkpoint.dir is not set: executors would write to folders of their own")
        base = "file://" + tempfile.mkdtemp(prefix="terrapoint-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) for metadata work on the driver."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = hadoop_path(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_once(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a small file under a temporary name and renames it without overwriting; False if the name was taken."""
    fs, final = hadoop_path(spark, path)
    temporary = hadoop_path(spark, f"{path}.{uuid.uuid4().hex}.tmp")[1]
    out = fs.create(temporary, True)
    out.write(bytearray(text.encode()))
    out.close()
    jvm = spark.sparkContext._jvm
    kind = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = kind.NONE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(temporary, final, options)
    except Exception:
        fs.delete(temporary, False)
        if fs.exists(final):
            return False
        raise
    return True


def _remove(spark: SparkSession, path: str) -> None:
    try:
        fs, p = hadoop_path(spark, path)
        fs.delete(p, True)
    except Exception:  # noqa: BLE001 - the session may be gone already
        return


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder under the shared one, removed when the driver ends."""
    path = f"{shared_dir(spark)}/terrapoint/{label}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def staged(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """df written to the shared folder and read back: cuts the lineage, and survives the loss of any executor."""
    path = path or scratch(df.sparkSession, label)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Removes staged tables whose readers have all been written themselves."""
    for df in frames:
        if path := getattr(df, "staged_at", None):
            _remove(df.sparkSession, path)
