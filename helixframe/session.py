"""Session helpers: a local session for tests/bench and a checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cpus: int | None = None, shuffle_partitions: int | None = None,
                  app: str = "helixframe") -> SparkSession:
    """A local session configured the way a cluster job would be (AQE on, UI off)."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    parts = shuffle_partitions or cpus
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.default.parallelism", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("HELIX_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, setting one only where none is configured.

    On a cluster the folder comes from ``spark.checkpoint.dir`` (a shared file
    system). Only a local master may fall back to a fresh temporary folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="helix-ckpt-"))
    return sc.getCheckpointDir()


def scratch_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder under the shared checkpoint folder; its file system deletes it when the application ends.

    Frames read intermediates lazily, so no earlier moment is known to be safe.
    """
    sc = spark.sparkContext
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    folder = sc._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(sc._jsc.hadoopConfiguration())
    files.mkdirs(folder)
    files.deleteOnExit(folder)
    return path


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name for one intermediate."""
    return f"{scratch_folder(spark, 'helix')}/{name}"


def materialize(df, name: str = "part", key: str | None = None):
    """Write ``df`` as parquet under the checkpoint folder and read it back.

    One job computes and writes the data (an RDD ``checkpoint`` computes it a
    second time to write it unless it was cached). The result has no lineage
    behind it, so a lost executor never re-runs the plan that produced it.
    With ``key``, a read-back that lands in too few partitions is spread by it.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    back = spark.read.parquet(path)
    if key is None:
        return back
    from .sources.tables import spread

    return spread(back, key)  # a small table reads back as one partition
