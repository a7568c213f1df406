"""Session helpers: a local session for tests, and tables stored in the shared folder.

On a cluster the session is created by the launcher; nothing here overrides
its settings.  ``local_session`` exists for tests, benches and the smoke entry.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
_SCRATCH: list[str] = []


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "labeltide", extra: dict[str, str] | None = None) -> SparkSession:
    """A local session configured the way the tests and the bench expect."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("LABELTIDE_DRIVER_MEMORY", "16g"))
    )
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the session.

    A cluster names a shared folder in ``spark.checkpoint.dir``; it is read,
    never replaced.  Only when it is unset and the master is local (tests) a
    scratch folder is created and registered; on a cluster that is an error,
    since executors would write to disks of their own.
    """
    sc = spark.sparkContext
    active = sc.getCheckpointDir()
    if active:
        return active
    named = sc.getConf().get(CHECKPOINT_CONF, None) or spark.conf.get(CHECKPOINT_CONF, None)
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="labeltide-ckpt-")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir() or named


def stored(df: DataFrame, name: str = "stored") -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back.

    Unlike a checkpoint it is compressed, is read column by column, and has a
    size that the planner knows, so a join broadcasts it only if its bytes are
    below ``spark.sql.autoBroadcastJoinThreshold``.  ``clear_scratch`` removes it.
    """
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> None:
    """Remove the intermediate tables written so far; results that read them must have been written out."""
    while _SCRATCH:
        path = spark._jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for written intermediate tables."""
    base = ensure_checkpoint_dir(spark)
    path = os.path.join(base, name)
    _SCRATCH.append(path)
    return path
