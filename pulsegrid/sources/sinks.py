"""Writers. All of them write in parallel and replace the target."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROW_GROUP_BYTES = 256 * 1024 * 1024


def write_parquet(
    df: DataFrame, path: str, partition_by: Sequence[str] = (), row_group_bytes: int = ROW_GROUP_BYTES,
    files_per_partition: int | None = None, spread_by: Sequence[str] = (),
) -> None:
    """Parquet partitioned by the given columns.

    With ``files_per_partition`` rows are first grouped by the partition columns
    and a hash of ``spread_by``: a bounded number of files per directory, and no
    single task for a directory that holds a third of the rows.
    """
    if files_per_partition is not None and partition_by:
        salt = F.pmod(F.xxhash64(*(spread_by or df.columns)), F.lit(files_per_partition))
        df = df.repartition(*[F.col(c) for c in partition_by], salt)
    writer = df.write.mode("overwrite").option("parquet.block.size", row_group_bytes)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
