"""Session settings and the shared scratch folder."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app: str = "tallyweave") -> SparkSession:
    """Session with the settings the operators rely on.

    ``master`` and ``shuffle_partitions`` are for local runs; on a cluster leave both unset,
    so that the submit-time settings and AQE coalescing decide.
    """
    b = (SparkSession.builder.appName(app)
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    if master:
        b = (b.master(master).config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "8g"))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, for written tables and stream checkpoints.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session without that setting
    gets a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if sc.applicationId not in _local_dirs:
        _local_dirs[sc.applicationId] = tempfile.mkdtemp(prefix="tallyweave-")
    return _local_dirs[sc.applicationId]


def _own_dir(spark: SparkSession) -> str:
    """The application's own folder under :func:`shared_dir`."""
    return os.path.join(shared_dir(spark), f"tallyweave-{spark.sparkContext.applicationId}")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the application's own folder."""
    return os.path.join(_own_dir(spark), f"{name}-{uuid.uuid4().hex}")


def drop_scratch(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application.

    For use between jobs: results that were built on them and are not yet stored become unreadable.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let shuffle files of finished results go. Spark deletes them once its driver has collected
    the objects that stand for them, which a driver with free memory puts off."""
    gc.collect()
    spark._jvm.System.gc()


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: computed once, lineage cut.

    Unlike cached blocks, the files survive the loss of executors.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table from :func:`written` that nothing reads any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
