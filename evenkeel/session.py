"""Sessions and the shared scratch folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_ROOTS: dict[str, str] = {}


def session(master: str = "local[*]", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with adaptive execution; on a cluster the submitted configuration holds instead."""
    return (
        SparkSession.builder.master(master).appName("evenkeel")
        .config("spark.sql.shuffle.partitions", str(partitions)).config("spark.driver.memory", memory)
        .config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )


def scratch_root(spark: SparkSession) -> str:
    """A folder in the one that all executors share (spark.checkpoint.dir), deleted when the session ends; one of our own only
    where that is unset and the session local."""
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
        if not base:
            if not spark.sparkContext.master.startswith("local["):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="evenkeel-")
        _ROOTS[app] = f"{base.rstrip('/')}/evenkeel-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, _ROOTS[app])
    return _ROOTS[app]


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _remove(spark: SparkSession, root: str) -> None:
    try:
        delete(spark, root)
    except Exception:  # the session is gone: what is left belongs to the folder's own clean-up
        pass


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The table written to the shared folder and read again: what follows neither computes it anew nor depends on executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def conf_int(spark: SparkSession, key: str, default: int | None = None) -> int:
    """A setting of the session as a whole number."""
    value = spark.conf.get(key, None if default is None else str(default))
    if value is None:
        raise KeyError(key)
    return int(value)


def parent_tasks(tasks: dict[str, int], *parents: str) -> int:
    """Tasks of all parents of an operator: as many reports end an epoch."""
    return sum(tasks[p] for p in parents)


def memory_info(spark: SparkSession) -> dict[str, int]:
    """Free and total MB of the driver's heap."""
    runtime = spark._jvm.java.lang.Runtime.getRuntime()
    return {"free_mb": runtime.freeMemory() >> 20, "total_mb": runtime.totalMemory() >> 20}
