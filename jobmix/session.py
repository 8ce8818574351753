"""SparkSession settings the reports are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Settings every run needs: UTC so date(ts) and week starts are stable, AQE so
# shuffle partitions coalesce and skewed join partitions are split at runtime.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def scale_conf(input_bytes: int, partition_bytes: int = 256 * 1024 * 1024) -> dict[str, str]:
    """Shuffle and scan sizing for an input of ``input_bytes``.

    The initial shuffle partition count gives every reducer about
    ``partition_bytes`` of the largest shuffle (never more than the input),
    AQE then coalesces small partitions toward the same advisory size and
    splits skewed ones; scans read splits of the same size.
    """
    partitions = max(1, -(-input_bytes // partition_bytes))
    return {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(partitions),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes),
        "spark.sql.files.maxPartitionBytes": str(partition_bytes),
    }


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "jobmix", extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with :data:`BASE_CONF`.

    On a cluster pass ``master=None`` and let spark-submit decide, and size
    shuffles to the input with ``extra=scale_conf(input_bytes)``.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    # getOrCreate may hand back an existing session: enforce the SQL confs.
    for k, v in conf.items():
        if k.startswith("spark.sql."):
            spark.conf.set(k, v)
    spark.sparkContext.setLogLevel("ERROR")
    return spark
