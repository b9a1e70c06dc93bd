"""Session builder with the settings the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(
    app_name: str = "pulsegrid",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    **extra: str,
) -> SparkSession:
    """Return a session in UTC with adaptive execution.

    ``master`` and ``shuffle_partitions`` are left to the cluster unless given.
    AQE coalesces small shuffle partitions and splits skewed join partitions,
    so a high ``shuffle_partitions`` is the safe choice on large inputs.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master is not None:
        builder = builder.master(master)
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
