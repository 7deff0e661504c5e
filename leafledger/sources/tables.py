"""Table scans and layout. Readers stay lazy, so filters and columns reach the Parquet scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import SCHEMAS, checked


def scan(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A stored table with its fixed schema; the scans below narrow it before anything is read."""
    return checked(spark.read.parquet(f"{root}/{name}"), name)


def scan_files(files: DataFrame, vault_id: str | None = None, content: bool = False) -> DataFrame:
    """Current rows, tombstones included; content columns only on request."""
    if vault_id is not None:
        files = files.filter(F.col("vault_id") == vault_id)
    return files if content else files.drop("content")


def scan_revisions(revisions: DataFrame, vault_id: str | None = None, path: str | None = None, rev: int | None = None) -> DataFrame:
    """Revisions, optionally of one vault, path or (path, rev)."""
    for column, value in (("vault_id", vault_id), ("path", path), ("rev", rev)):
        if value is not None:
            revisions = revisions.filter(F.col(column) == value)
    return revisions


def scan_receipts(receipts: DataFrame) -> DataFrame:
    return checked(receipts, "receipts")


def scan_blob_inventory(inventory: DataFrame) -> DataFrame:
    return checked(inventory, "blob_inventory")


def scan_observations(observations: DataFrame) -> DataFrame:
    return checked(observations, "observations")


def read_feed(changes: DataFrame, after_seq: int = 0, head_seq: int | None = None) -> DataFrame:
    """Feed rows with ``after_seq < seq <= head_seq``."""
    rows = changes.filter(F.col("seq") > after_seq)
    return rows if head_seq is None else rows.filter(F.col("seq") <= head_seq)


def stream_table(spark: SparkSession, root: str, name: str, max_files: int = 1_000) -> DataFrame:
    """An append-only table as a stream with its fixed schema; a trigger reads at most ``max_files``."""
    return spark.readStream.schema(SCHEMAS[name]).option("maxFilesPerTrigger", max_files).parquet(f"{root}/{name}")


def read_observations(spark: SparkSession, root: str, max_files: int = 1_000) -> DataFrame:
    return stream_table(spark, root, "observations", max_files)


def write_files(files: DataFrame, root: str) -> None:
    """Current rows range-sorted by (vault_id, path): keyset pages and prefix listings then
    skip row groups, and one large vault still spreads over many files."""
    checked(files, "files").repartitionByRange("vault_id", "path").sortWithinPartitions("vault_id", "path").write.mode(
        "overwrite"
    ).parquet(f"{root}/files")


def append_log(rows: DataFrame, root: str, name: str) -> None:
    """Append rows of a log table."""
    checked(rows, name).write.mode("append").parquet(f"{root}/{name}")


def bucket_table(df: DataFrame, table: str, buckets: int, *keys: str) -> None:
    """Managed table bucketed and sorted by join keys, so repeated joins on them do not shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)
