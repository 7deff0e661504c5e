"""Append-only state of streaming jobs as Parquet folders, one per batch.

Every batch overwrites its own folder, so a batch that is run again after a lost
executor or driver leaves the same state. ``compact`` writes the newest row per key as
one base folder; later reads take that base and only the batches after it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def write_batch(df: DataFrame, root: str, name: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{root}/{name}/batch={batch_id:012d}")


def read_before(spark: SparkSession, root: str, name: str, batch_id: int) -> DataFrame | None:
    """Rows of earlier batches with their ``batch`` number, from the newest compaction on."""
    try:
        rows = spark.read.option("basePath", f"{root}/{name}").parquet(f"{root}/{name}")
    except AnalysisException:
        return None
    rows = rows.withColumn("batch", F.col("batch").cast("long")).filter(F.col("batch") < batch_id)
    return None if rows.isEmpty() else rows


def newest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Latest batch's row per key."""
    columns = [c for c in rows.columns if c not in keys and c != "batch"]
    picked = rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), "batch").alias("s"))
    return picked.select(*keys, "s.*")


def read_state(spark: SparkSession, root: str, name: str, batch_id: int) -> DataFrame | None:
    """Rows that decide the state before ``batch_id``: the newest base and the batches after it."""
    base = read_before(spark, root, f"{name}_base", batch_id)
    rows = read_before(spark, root, name, batch_id)
    if base is None:
        return rows
    top = base.agg(F.max("batch")).first()[0]  # one number
    base = base.filter(F.col("batch") == top)
    return base if rows is None else base.unionByName(rows.filter(F.col("batch") > top))


def compact(spark: SparkSession, root: str, name: str, keys: list[str], batch_id: int) -> None:
    """Base folder with the state after ``batch_id``; running it again writes the same."""
    rows = read_state(spark, root, name, batch_id + 1)
    if rows is not None:
        write_batch(newest(rows, keys), root, f"{name}_base", batch_id)
