"""Session helpers: building a session and finding the shared work folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # remove reliable-checkpoint files once the checkpointed data is no longer referenced
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # Spark 4.1 lets a union of key-partitioned inputs report that partitioning;
    # with adaptive execution this can leave a later keyed join with inputs of
    # different partition counts ("Can't zip RDDs with unequal numbers of
    # partitions"). Upserts join unions of fact rows on the key, so it is off.
    "spark.sql.unionOutputPartitioning": "false",
    # counts and bounds from Parquet footers where a table is read for them (sources/footers.py)
    "spark.sql.parquet.aggregatePushdown": "true",
}

RUNTIME_CONF = {k: DEFAULT_CONF[k] for k in ("spark.sql.unionOutputPartitioning", "spark.sql.parquet.aggregatePushdown")}


def ensure_runtime_conf(spark: SparkSession) -> None:
    """Apply the runtime SQL settings the operators rely on to a session the
    caller built (see ``DEFAULT_CONF`` for why)."""
    for k, v in RUNTIME_CONF.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)


def get_session(master: str | None = None, app: str = "kpiforge", shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    """Return the active session or build one with the library defaults.

    An active session (for example one created by a cluster launcher) is
    returned unchanged: its configuration belongs to the caller.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this must be a shared file system path set by the cluster
    configuration. Only a local-mode session without the setting (tests,
    notebooks) gets a private folder of its own.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if root:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(root)
        return root.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set; a shared folder is required on a cluster")
    root = tempfile.mkdtemp(prefix="kpiforge-ckpt-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    sc.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path below the shared checkpoint folder. Spark's writers make the folders."""
    return f"{checkpoint_root(spark)}/kpiforge/{name}-{uuid.uuid4().hex[:12]}"


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch path through Spark's file system layer."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def size_partitions(spark: SparkSession, input_bytes: int, target_bytes: int = 128 * 1024 * 1024,
                    min_partitions: int | None = None) -> int:
    """Size shuffles and file splits for an input of ``input_bytes``.

    Sets ``spark.sql.shuffle.partitions`` (and the adaptive initial partition
    count) so that a shuffle partition holds about ``target_bytes`` of input,
    never fewer than the cluster's default parallelism; adaptive execution then
    coalesces small partitions at run time (``advisoryPartitionSizeInBytes``)
    and splits skewed ones. File splits use the same target. Returns the count.
    """
    floor = min_partitions or spark.sparkContext.defaultParallelism
    n = max(floor, -(-int(input_bytes) // int(target_bytes)))
    for k, v in {
        "spark.sql.shuffle.partitions": str(n),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(n),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(int(target_bytes)),
        "spark.sql.files.maxPartitionBytes": str(int(target_bytes)),
    }.items():
        spark.conf.set(k, v)
    return n
