"""Session construction and lineage helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tallyspark", cores: int | str | None = None,
                  shuffle_partitions: int | None = None) -> SparkSession:
    """Session with AQE on, UI off, UTC.  ``cores`` asks for a local master;
    without it the master of spark-submit (or Spark's default) holds."""
    parts = shuffle_partitions or (os.cpu_count() or 8)
    builder = SparkSession.builder.appName(app)
    if cores is not None:
        builder = builder.master(f"local[{cores}]")
    spark = (
        builder
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's ``spark.checkpoint.dir``; only set one when unset.

    On a cluster the setting names a shared folder (HDFS/S3/...); without
    it this raises, as a machine-local folder would be another one on each
    executor.  With a local master (tests, bench) a scratch folder is made.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect has no SparkContext
        sc = None
    if sc is not None and sc.getCheckpointDir():
        return sc.getCheckpointDir()
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir and sc is not None:
        conf_dir = sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        master = sc.master if sc is not None else "remote"
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        conf_dir = tempfile.mkdtemp(prefix="tallyspark-ckpt-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", conf_dir)
    if sc is None:
        return conf_dir
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def app_id(spark: SparkSession) -> str:
    """The running application's id (classic or Connect session)."""
    try:
        return spark.sparkContext.applicationId
    except Exception:  # noqa: BLE001
        return spark.conf.get("spark.app.id", "app")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder.

    Survives executor loss (unlike ``localCheckpoint``) and keeps iterative
    plans (horizon loops) from growing without bound.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once as a Parquet table under the shared checkpoint
    folder and read it back: lineage is cut, every later branch reads the
    columnar files instead of recomputing (and the files survive executor
    loss).  Used for aggregated tables that several branches consume; the
    job runs at once, and ``release`` removes the files."""
    path = f"{tables_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    out = df.sparkSession.read.parquet(path)
    out._written_at = path
    return out


def discard(df: DataFrame) -> None:
    """Remove the files of a frame that ``materialize`` returned, once no
    frame built on it is read any more."""
    at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written_at)
    at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def tables_root(spark: SparkSession) -> str:
    """The application's folder of intermediate tables in shared storage."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{app_id(spark)}"


def release(spark: SparkSession) -> None:
    """Remove the application's intermediate tables; call it when no frame
    built so far is read any more (a job's end)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(tables_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
