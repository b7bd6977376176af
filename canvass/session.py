"""Spark session and checkpoint helpers.

Every operator in this package is DataFrame in, DataFrame out. The only
session-level concerns are (a) sane defaults for local runs and (b) a
reliable checkpoint directory for the few operators that cut lineage
(see ``operators/ranking.py``).
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # checkpoint files are removed once the checkpointed frame is garbage
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "canvass", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the package defaults.

    On a cluster, ``master`` stays ``None`` and the launcher decides; local
    runs pass ``local[N]`` and a matching shuffle partition count.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if master and master.startswith("local"):
        conf.setdefault("spark.driver.memory", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Make sure ``DataFrame.checkpoint()`` has a reliable directory.

    Order: an already set directory; ``spark.checkpoint.dir`` from the session
    (the shared folder a cluster names); for local masters only, a fresh
    temporary folder. A cluster without the setting is an error, because a
    machine-local folder would not survive the loss of an executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return configured
    if sc.master.startswith("local"):
        path = tempfile.mkdtemp(prefix="canvass-ckpt-", dir=os.environ.get("CANVASS_SCRATCH", "/tmp"))
        sc.setCheckpointDir(path)
        return path
    raise RuntimeError(
        "spark.checkpoint.dir is not set; set it to a shared folder (HDFS/S3/ABFS) "
        "so checkpointed stages survive executor loss")


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """Eagerly checkpoint ``df`` to the shared checkpoint directory."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, label: str, metrics: dict | None = None) -> tuple[DataFrame, dict]:
    """Write ``df`` once to the shared checkpoint folder and read it back; ``metrics`` (name -> aggregate column) are
    observed on the rows as they pass to the files, so counts and checks need no scan of their own."""
    from pyspark.sql import Observation
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/canvass-{label}-{uuid.uuid4().hex}"
    observed = None
    out = df
    if metrics:
        observed = Observation(f"{label}-{uuid.uuid4().hex}")
        out = df.observe(observed, *[c.alias(n) for n, c in metrics.items()])
    out.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), dict(observed.get) if observed else {}


def cluster_conf(input_bytes: int, total_cores: int, partition_bytes: int = 256 * 1024 ** 2) -> dict:
    """Partition sizing for a cluster run over ``input_bytes`` of input.

    Shuffle partitions start at input / 256 MB (at least two per core)
    so no task's shuffle block outgrows executor
    memory at the target scale; AQE then coalesces small partitions and
    splits skewed ones (a partition over 4x the advisory size is skewed).
    The same count sizes the range partitioning of the distributed ranks.
    """
    import math
    n = max(2 * total_cores, math.ceil(input_bytes / partition_bytes))
    return {
        "spark.sql.shuffle.partitions": str(n),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(n),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes),
        "spark.sql.files.maxPartitionBytes": str(partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * partition_bytes),
        # broadcast only what AQE measures below 64 MB at run time
        "spark.sql.autoBroadcastJoinThreshold": str(64 * 1024 ** 2),
        "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 * 1024 ** 2),
    }
