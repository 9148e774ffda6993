"""Where intermediate tables live, so that a lost executor costs no more than its own tasks."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or one of our own where it is unset (single machine)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        found = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = _OWN.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="fernwerk-"))
    return found


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it goes when the session's Python ends."""
    path = f"{shared_dir(spark).rstrip('/')}/fernwerk/{name}-{uuid.uuid4().hex}"

    def drop() -> None:
        try:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001  the session may have ended before
            pass

    atexit.register(drop)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """The rows written as Parquet to the shared folder and read back: cuts the lineage and bounds recomputation."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._fernwerk_path = path
    return out


def release(df: DataFrame) -> None:
    """Deletes a table of `materialise` that nothing reads any more: what was made of it has been written too."""
    path = getattr(df, "_fernwerk_path", None)
    if path:
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
