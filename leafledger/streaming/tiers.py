"""A tiered index: runs of rows by size, merged a tier at a time.

Each batch writes one run: its rows and the paths it touched. A row is in force if no later batch touched its path, so the
touched paths of the later runs say which rows of a run are dead. When a tier holds ``fan`` runs, they become one run of the next
tier: dead rows go, and of each path the last batch stays. A merge that holds the oldest run also forgets paths without rows. So
every row is written once per tier, and a reader opens at most ``fan - 1`` runs of each tier.

Runs have names of their own and are never changed; a manifest per batch lists those in force. A batch that is run again writes
the same names and the same manifest. Runs that no manifest in use lists may be deleted by whoever keeps the folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import read_before, write_batch

FAN = 4
KEYS = ["vault_id", "path"]
_MANIFEST = "tier int, first long, last long"


def _folder(root: str, run: tuple[int, int, int], kind: str) -> str:
    tier, first, last = run
    return f"{root}/runs/tier={tier}/{first:012d}-{last:012d}/{kind}"


def live_runs(spark: SparkSession, root: str, batch_id: int = 2**62) -> list[tuple[int, int, int]]:
    """(tier, first batch, last batch) of the runs in force before ``batch_id``, oldest first; a bounded number per tier."""
    listed = read_before(spark, root, "manifest", batch_id)
    if listed is None:
        return []
    top = listed.agg(F.max("batch")).first()[0]
    return sorted(((r.tier, r["first"], r.last) for r in listed.filter(F.col("batch") == top).collect()), key=lambda r: r[1])


def _read(spark: SparkSession, root: str, runs: list[tuple[int, int, int]], kind: str) -> DataFrame:
    return spark.read.parquet(*[_folder(root, run, kind) for run in runs])


def _in_force(spark: SparkSession, root: str, runs: list[tuple[int, int, int]]) -> tuple[DataFrame, DataFrame]:
    """Rows that no later batch of these runs touched, and the last batch of each path."""
    touched = _read(spark, root, runs, "touched").groupBy(*KEYS).agg(F.max("batch").alias("batch"))
    return _read(spark, root, runs, "rows").join(touched, [*KEYS, "batch"], "left_semi"), touched


def read_index(spark: SparkSession, root: str) -> DataFrame | None:
    """The rows in force of the whole index; None before the first batch."""
    runs = live_runs(spark, root)
    return None if not runs else _in_force(spark, root, runs)[0].drop("batch")


def add_run(root: str, batch_id: int, rows: DataFrame, touched: DataFrame, fan: int = FAN) -> None:
    """Add a batch: ``rows`` replace all earlier rows of the ``touched`` paths (vault_id, path). Merges what is due."""
    spark = rows.sparkSession
    number = F.lit(batch_id).cast("long")
    fresh = (0, batch_id, batch_id)
    rows.withColumn("batch", number).write.mode("overwrite").parquet(_folder(root, fresh, "rows"))
    touched.select(KEYS).distinct().withColumn("batch", number).write.mode("overwrite").parquet(_folder(root, fresh, "touched"))
    runs = [*live_runs(spark, root, batch_id), fresh]
    tier = 0
    while len(due := [r for r in runs if r[0] == tier]) >= fan:
        merged = (tier + 1, due[0][1], due[-1][2])
        kept, last = _in_force(spark, root, due)
        kept.write.mode("overwrite").parquet(_folder(root, merged, "rows"))
        if due[0] == runs[0]:
            # Nothing older is left that a path without rows would have to hide.
            last = last.join(_read(spark, root, [merged], "rows").select(KEYS).distinct(), KEYS, "left_semi")
        last.write.mode("overwrite").parquet(_folder(root, merged, "touched"))
        runs = sorted([r for r in runs if r not in due] + [merged], key=lambda r: r[1])
        tier += 1
    write_batch(spark.createDataFrame(runs, _MANIFEST).coalesce(1), root, "manifest", batch_id)
