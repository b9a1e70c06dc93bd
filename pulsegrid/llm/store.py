"""Intermediate tables in the folder all machines share."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder ``spark.checkpoint.dir`` names; where it is unset (tests on one machine), a folder of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = tempfile.mkdtemp(prefix="pulsegrid-llm-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str, partition_by: str | None = None, compression: str | None = None) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again, which cuts its lineage.

    A lost executor then costs a re-read of files, not the jobs before.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(partition_by)
    if compression:
        writer = writer.option("compression", compression)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def held_out(doc_id) -> "F.Column":
    """The fold that no model learns from: crc32 of the id as text, modulo 5, is 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bitmap(rows: DataFrame, slot: Column, bits: int) -> np.ndarray:
    """64-bit words of a bitmap in which the slots (0 to 2**bits - 1) of all rows are set.

    Words are put together by Spark; at most 2**(bits - 6) of them reach the driver, whatever the rows.
    """
    slots = rows.select(F.shiftright(slot, 6).alias("word"), F.pmod(slot, F.lit(64)).cast("int").alias("bit"))
    words = slots.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out.view(np.uint64)
