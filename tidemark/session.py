"""Session helpers: a tuned local session for tests/bench, and reliable
lineage cuts through the cluster's shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "tidemark") -> SparkSession:
    """Session for tests and the bench. On a cluster, build your own session;
    the operators do not depend on any of these settings for correctness."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # AQE may replace a sort-merge join by a shuffled hash join when every
        # runtime partition of the build side fits this bound (runtime stats).
        .config("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "64MB")
        # Broadcasts come from counted bounds (operators.joins.attach) or from AQE's
        # measured stage sizes, never from plan estimates.
        .config("spark.sql.autoBroadcastJoinThreshold", "-1")
        .config("spark.sql.adaptive.autoBroadcastJoinThreshold", "32MB")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def cluster_conf(input_bytes: int, total_cores: int, partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Settings for a cluster run sized from the input: scan splits and shuffle
    partitions of about ``partition_bytes`` each (at least two waves of the
    cluster's cores), AQE coalescing toward the same size, and skew splitting.
    Pass them to ``SparkSession.builder.config`` (the operators do not depend
    on them for correctness)."""
    # Raw-row shuffles (joins) move about the input size; aggregated stages far
    # less, and AQE coalesces those at runtime toward ``partition_bytes``.
    shuffle = max(2 * total_cores, input_bytes // partition_bytes)
    return {
        "spark.sql.files.maxPartitionBytes": str(partition_bytes),
        "spark.sql.shuffle.partitions": str(shuffle),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * partition_bytes),
        "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": str(partition_bytes),
        # no broadcast from plan estimates; AQE broadcasts only from measured sizes
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 << 20),
    }


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    The setting is read from the session (``spark.checkpoint.dir`` or an
    earlier ``setCheckpointDir``). Only a local-mode session (tests, bench)
    may get a private folder of its own; on a cluster a missing setting is
    an error, because a machine-local folder does not survive executor loss.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-ckpt-"))
        return sc.getCheckpointDir()
    raise RuntimeError("spark.checkpoint.dir is not set; point it at a shared folder")


_scope: ContextVar[str | None] = ContextVar("tidemark_stage_scope", default=None)


def stage_folder(spark: SparkSession) -> str:
    """Folder of this application's stage tables inside the shared checkpoint
    folder: one place to delete (or expire) when the application is done."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    folder = f"{base}/tidemark-stages/{spark.sparkContext.applicationId}"
    return f"{folder}/{_scope.get()}" if _scope.get() else folder


@contextmanager
def stage_scope(spark: SparkSession):
    """Stage tables written inside are deleted at its end, also after an error: for jobs that have
    written their results elsewhere by then. Other stage tables of the application stay."""
    token = _scope.set(f"job-{uuid.uuid4().hex}")
    folder = spark._jvm.org.apache.hadoop.fs.Path(stage_folder(spark))
    try:
        yield
    finally:
        _scope.reset(token)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage: write ``df`` as a Parquet table in the shared checkpoint
    folder and read it back.

    Used at stage boundaries (the tagged item table, the per-(entity, period)
    frame that several outputs reuse and whose size drives broadcast
    decisions). Parquet instead of ``DataFrame.checkpoint``: columnar, so
    later reads prune columns, and much cheaper to write than serialized
    rows. The folder is the cluster's shared one, so the table survives the
    loss of any executor.
    """
    spark = df.sparkSession
    path = f"{stage_folder(spark)}/{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_observed(df: DataFrame, **metrics: Column) -> tuple[DataFrame, dict]:
    """``materialize`` that also returns aggregate metrics gathered while the
    table is written (``Observation``): no second pass over the data.
    ``rows`` (the row count) is always included."""
    obs = Observation(f"tidemark-{uuid.uuid4().hex}")
    observed = df.observe(obs, F.count(F.lit(1)).alias("rows"), *[m.alias(k) for k, m in metrics.items()])
    stored = materialize(observed)
    return stored, obs.get
