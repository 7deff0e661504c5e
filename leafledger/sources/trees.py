"""File trees through ``binaryFile``: local listings, notes with strict UTF-8, blob inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _binary(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)


def _relative(folder: str) -> Column:
    root = folder.rstrip("/").removeprefix("file:")
    return F.regexp_replace(F.url_decode(F.replace(F.col("path"), F.lit("+"), F.lit("%2B"))), r"^.*?" + "\\Q" + root + "\\E/", "")


def scan_local_tree(spark: SparkSession, folder: str, device_id: str, vault_id: str) -> DataFrame:
    """Path, size, modification time and byte hash of every file below ``folder``."""
    return _binary(spark, folder).select(
        F.lit(device_id).alias("device_id"), F.lit(vault_id).alias("vault_id"), _relative(folder).alias("path"),
        F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime"), F.sha2("content", 256).alias("hash"),
    )


def load_notes(spark: SparkSession, folder: str, vault_id: str) -> DataFrame:
    """Text of every file; ``reason`` where the bytes are not strict UTF-8. A byte-order mark stays."""
    text = F.col("content").cast("string")
    valid = F.is_valid_utf8(text)
    return _binary(spark, folder).select(
        F.lit(vault_id).alias("vault_id"), _relative(folder).alias("path"), F.col("length").alias("size"),
        F.when(valid, text).alias("content"), F.when(~valid, "invalid_utf8").alias("reason"),
    )


def list_blobs(spark: SparkSession, folder: str, vault_id: str) -> DataFrame:
    """Inventory of stored blobs named by hash; bytes are not read."""
    return _binary(spark, folder).select(
        F.lit(vault_id).alias("vault_id"), F.regexp_extract("path", r"([^/]*)$", 1).alias("hash"), F.col("length").alias("size")
    )
