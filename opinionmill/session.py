"""Session defaults and the folder for files that outlive a task."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Folders that this process has named.
_folders: list[str] = []


def session(master: str | None = None, app: str = "opinionmill", **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; `conf` overrides (dots written as double underscores)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {"spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    for key, value in (defaults | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the cluster's shared checkpoint folder; only a local session may leave that unset and gets a temporary one."""
    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    base = base or tempfile.mkdtemp(prefix="spark-shared-")
    _folders.append(f"{base}/{name}-{uuid.uuid4().hex}")
    return _folders[-1]


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once to a shared folder for the several jobs that read them."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def clear_shared(spark: SparkSession) -> int:
    """Removes the folders that `shared_folder` named since the last call, once nothing reads them any more; their number."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    n = 0
    while _folders:
        path = jvm.org.apache.hadoop.fs.Path(_folders.pop())
        n += bool(path.getFileSystem(conf).delete(path, True))
    return n
