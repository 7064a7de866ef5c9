"""Spark session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime settings the operators rely on; cluster sizing is left to the caller.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join even where an aggregate on the same key follows it.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Rows here are whole series: small batches keep Python workers small.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    # Only the run's own partitions are replaced when results are saved again.
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session that exists already."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cpus: int | str = "*", memory: str = "8g") -> SparkSession:
    """A session for tests and the benchmark on one machine."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("caseload")
    partitions = "8" if cpus == "*" else str(cpus)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return (
        builder.config("spark.sql.shuffle.partitions", partitions)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder path that every executor can reach.

    Clusters name the shared place in ``spark.checkpoint.dir`` or set a checkpoint
    folder. Only a local master, where all is one machine, falls back on a temporary
    folder; any other is refused. All folders of one application lie together, so
    :func:`release` can drop them after the run.
    """
    return f"{_application_folder(spark)}/{purpose}-{uuid.uuid4().hex}"


_LOCAL_ROOTS: dict[str, str] = {}


def _application_folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if context.applicationId not in _LOCAL_ROOTS:
            _LOCAL_ROOTS[context.applicationId] = tempfile.mkdtemp(prefix="caseload-")
        root = _LOCAL_ROOTS[context.applicationId]
    return f"{root.rstrip('/')}/caseload/{context.applicationId}"


def release(spark: SparkSession) -> None:
    """Delete what this application has left in the shared folder.

    For the end of a run: no table read back from there can be used afterwards.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(_application_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used for costly results that feed several tables (model fits), and for small
    tables that are joined to raw rows: the planner then knows their true size and
    broadcasts them only below its threshold, instead of shuffling the raw rows on
    a guess. The copy cuts the lineage and survives the loss of executors.
    """
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def compute_partitions(spark: SparkSession) -> int:
    """Partitions for CPU-bound work over few bytes.

    AQE merges shuffle partitions by size; a fixed number keeps the model fits
    spread over all cores although a million series weigh only megabytes.
    """
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(shuffle, spark.sparkContext.defaultParallelism)
