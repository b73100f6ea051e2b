"""Session construction and the shared (cluster-visible) scratch location."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(cores: int | str = "*", app: str = "insight", shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Local session for tests and the bench.

    On a cluster the session comes from ``spark-submit`` and this function is
    not used; every setting here is a plain Spark conf that a cluster profile
    would carry as well (AQE, skew join, UTC session zone, UI off).
    """
    parts = shuffle_partitions or (8 if cores == "*" else max(int(cores), 1))
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("INSIGHT_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_root(spark)
    return spark


def cluster_settings(input_bytes: int, target_partition_bytes: int = 256 * 1024 ** 2) -> dict[str, str]:
    """Spark confs for a large cluster run (pass to ``spark-submit --conf``).

    * the initial shuffle partition count follows the input size (about
      ``target_partition_bytes`` per task, 200 at least, which is Spark's own
      default), and AQE coalesces small ones and splits skewed ones at runtime;
      ``rank_within`` also uses it as its number of key ranges.  Raise
      ``target_partition_bytes`` where map tasks x reducers blocks get too many;
    * file splits of the same size keep scan tasks within executor memory;
    * broadcasts stay behind explicit, measured bounds in the code; the
      planner's own threshold is kept moderate.
    """
    parts = max(200, -(-int(input_bytes) // target_partition_bytes))
    size = str(target_partition_bytes)
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": size,
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": size,
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.files.maxPartitionBytes": size,
        "spark.sql.autoBroadcastJoinThreshold": str(64 * 1024 ** 2),
        "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 * 1024 ** 2),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.parquet.filterPushdown": "true",
        "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
    }


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Read from the session.  Only a local session that names none (tests) gets a
    temporary folder; elsewhere that would put scratch tables on single
    machines' own disks, so it is an error.
    """
    sc = spark.sparkContext
    root = sc.getCheckpointDir()
    if root:
        return root.rstrip("/")
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="insight-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir().rstrip("/")


def scratch_root(spark: SparkSession) -> str:
    """This application's scratch folder; :func:`remove_scratch` deletes it."""
    return f"{checkpoint_root(spark)}/insight-scratch/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared checkpoint root for a landing table."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def land(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once below the shared folder and read it back with its declared schema.

    Several branches can then use the same physical rows, and a lost executor
    reads them again instead of deriving them again.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def remove_scratch(spark: SparkSession) -> None:
    """Delete this application's scratch tables, and the catalogue entries of tables in that folder: once its results
    are written, before it stops."""
    root = scratch_root(spark)
    for t in spark.catalog.listTables():
        if t.isTemporary:
            continue
        described = spark.sql(f"DESCRIBE TABLE EXTENDED `{t.name}`").filter("col_name = 'Location'").first()
        if described and f"/insight-scratch/{spark.sparkContext.applicationId}/" in described["data_type"]:
            spark.sql(f"DROP TABLE IF EXISTS `{t.name}`")
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
