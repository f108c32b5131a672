"""Session settings and the shared folder for tables that cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Runtime settings every job here relies on. The co-partition one lets a panel
# that is already hashed by symbol join on (symbol, rebalance_date) unshuffled.
RUNTIME_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.session.timeZone": "UTC",
}

WAVES = 4  # shuffle partitions for each core, where they are not tiny

# Drops a finished write's shuffle files at once instead of whenever the driver next collects garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_local_dirs: dict[str, str] = {}
_shipped: set[str] = set()


def local_session(app: str = "basketry", cores: int | str = "*", memory: str = "12g") -> SparkSession:
    """A local session for tests and benches; clusters bring their own."""
    n = os.cpu_count() if cores == "*" else int(cores)
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings and make this package importable in Python workers."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    # With one shuffle partition a core, a last one that is left over doubles the time of the stage.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionNum", str(WAVES * spark.sparkContext.defaultParallelism))
    return ship(spark)


def ship(spark: SparkSession) -> SparkSession:
    """Hand this package to the executors, once per application; no setting is changed."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        package = os.path.dirname(os.path.abspath(__file__))
        archive = os.path.join(tempfile.mkdtemp(prefix="spark-"), "basketry.zip")
        with zipfile.ZipFile(archive, "w") as z:
            for folder, _, files in os.walk(package):
                for name in files:
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        z.write(path, os.path.join("basketry", os.path.relpath(path, package)))
        spark.sparkContext.addPyFile(archive)  # Spark's file server hands it to every executor
        _shipped.add(app)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the configured checkpoint folder, or the one set on the context.

    Only a local master, where all run on one machine, may do without: it gets a fresh temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="spark-")
    return _local_dirs[app]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once under the shared folder and read it back.

    Used where a result is read by several branches that must agree exactly, or
    inside an iteration: the written table survives lost executors and carries
    file sizes, so the optimiser can still pick broadcast joins from it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete every table that ``materialize`` wrote for this application."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
