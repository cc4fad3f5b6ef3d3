"""Session construction and shared-folder helpers.

On a cluster the session is created by the platform; ``ensure_checkpoint_dir``
only fills in ``spark.checkpoint.dir`` when nothing set it (tests, local runs).
Scratch output (published round trips, refreshed seasons in examples) always
goes below that shared folder, never to a machine-local temporary path.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # No broadcast from static file-size estimates (a join of estimates can
    # make the fact table look smaller than its dimension). Broadcasts come
    # from measured sizes only: AQE's runtime statistics, or the explicit
    # row-count probe of ``plans.physical.bounded_broadcast``.
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "10MB",
    # Coalesced shuffle partitions may go down to 256 KB (default 1 MB) so small
    # inputs still use every core; large inputs are governed by the advisory size.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "256KB",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Whole-stage generated methods of wide plans (many columns through
    # several joins) exceed HotSpot's 8000-byte JIT limit and would stay
    # interpreted; let the JIT compile them (driver and executors).
    "spark.driver.extraJavaOptions": "-XX:-DontCompileHugeMethods",
    "spark.executor.extraJavaOptions": "-XX:-DontCompileHugeMethods",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(
    master: str | None = None,
    app: str = "matchup",
    shuffle_partitions: int | None = None,
    driver_memory: str = "8g",
    extra: dict | None = None,
) -> SparkSession:
    """Create (or reuse) a session with the settings the operators assume."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(_DEFAULTS)
    conf["spark.driver.memory"] = driver_memory
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, creating a local one only if unset."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        # Unset: a local run or a test. A cluster has to name a shared folder.
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        configured = tempfile.mkdtemp(prefix="matchup-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the shared checkpoint folder."""
    root = ensure_checkpoint_dir(spark)
    return os.path.join(root, "matchup-scratch", f"{name}-{uuid.uuid4().hex[:12]}")


def drop_folder(spark: SparkSession, path: str) -> None:
    """Remove a scratch folder that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def folder_exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def write_small(spark: SparkSession, path: str, text: str) -> None:
    """Write or replace a small text file; a reader sees the old or the new text, whole (a single rename)."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    to = hadoop.Path(path)
    tmp = hadoop.Path(f"{path}.{uuid.uuid4().hex[:12]}")
    fs = to.getFileSystem(conf)
    out = fs.create(tmp, True)
    out.write(bytearray(text.encode()))
    out.close()
    rename = getattr(hadoop, "Options$Rename")
    overwrite = spark.sparkContext._gateway.new_array(rename, 1)
    overwrite[0] = rename.OVERWRITE
    hadoop.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(tmp), fs.makeQualified(to), overwrite)


def read_small(spark: SparkSession, path: str) -> str:
    """Text of a file that ``write_small`` wrote."""
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()).strip()
