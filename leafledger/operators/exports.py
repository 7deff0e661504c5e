"""Consistent snapshots: capture, write, verify, restore and run states."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import prefix_scan


def capture_snapshot(files: DataFrame, revisions: DataFrame) -> DataFrame:
    """Live files with ``source_type`` and ``reason`` where file and revision disagree."""
    old = revisions.select(
        "vault_id", "path", "rev", F.col("hash").alias("r_hash"), F.col("size").alias("r_size"), F.col("kind").alias("r_kind"),
        F.col("deleted").alias("r_deleted"), F.col("blob_hash").alias("r_blob"), F.octet_length("content").alias("r_bytes"),
    )
    live = files.filter(~F.col("deleted")).select(
        "vault_id", "path", "rev", "hash", "size", "kind", "blob_hash", F.octet_length("content").alias("bytes")
    )
    both = live.join(old, ["vault_id", "path", "rev"], "left")
    has = F.col("r_hash").isNotNull()
    no = F.lit(False)
    disagree = has & (
        (F.col("hash") != F.col("r_hash")) | (F.col("size") != F.col("r_size")) | (F.col("kind") != F.col("r_kind")) | F.col("r_deleted")
    )
    text_ok = (F.col("bytes") == F.col("size")) & F.col("blob_hash").isNull()
    text_ok = text_ok & (~has | ((F.col("r_bytes") == F.col("size")) & F.col("r_blob").isNull()))
    blob_ok = F.col("bytes").isNull() & (F.col("blob_hash") == F.col("hash"))
    blob_ok = blob_ok & (~has | (F.col("r_bytes").isNull() & (F.col("r_blob") == F.col("hash"))))
    sound = F.when(F.col("kind") == "text", F.coalesce(text_ok, no)).when(F.col("kind") == "blob", F.coalesce(blob_ok, no)).otherwise(no)
    origin = F.when(has, "revision_").otherwise("snapshot_")
    return both.select(
        "vault_id", "path", "rev", "hash", "size", F.concat(origin, "kind").alias("source_type"),
        F.when(F.coalesce(disagree, F.lit(True)) & has, "revision_mismatch").when(~sound, "payload_mismatch").alias("reason"),
    )


def snapshot_ordinals(snapshot: DataFrame) -> DataFrame:
    """0-based position of every path in binary order per vault, over range slices."""
    ranked = prefix_scan(snapshot, ["vault_id"], ["path"], {"ordinal": F.lit(1)})
    return ranked.withColumn("ordinal", F.col("ordinal") - 1)


def snapshot_checks(snapshot: DataFrame, summary: DataFrame, file_limit: int | None = None) -> DataFrame:
    """Totals per vault against the live counter and, if given, a limit; only ``ok`` ones may be written."""
    totals = snapshot.groupBy("vault_id").agg(
        F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"), F.count("reason").alias("bad_rows")
    )
    return totals.join(summary.select("vault_id", "live"), "vault_id").withColumn(
        "verdict",
        F.when(F.col("bad_rows") > 0, "source_failure").when(F.lit(file_limit is not None) & (F.col("files") > (file_limit or 0)), "too_many_files")
        .when(F.col("files") != F.col("live"), "count_mismatch").otherwise("ok"),
    )


def snapshot_payload(snapshot: DataFrame, files: DataFrame, blobs: DataFrame) -> DataFrame:
    """The bytes of every sound row: the text itself, or the blob from the store ``blobs`` (vault_id, hash, content).

    ``bytes`` is NULL where the store has no such blob; verification reports it.
    """
    keys = ["vault_id", "path", "rev"]
    rows = snapshot.filter(F.col("reason").isNull()).select(*keys).join(files.select(*keys, "content", "blob_hash"), keys)
    texts = rows.filter(F.col("blob_hash").isNull()).withColumn("bytes", F.encode("content", "UTF-8"))
    store = blobs.select("vault_id", F.col("hash").alias("blob_hash"), F.col("content").alias("bytes")).dropDuplicates(["vault_id", "blob_hash"])
    held = rows.filter(F.col("blob_hash").isNotNull()).join(store, ["vault_id", "blob_hash"], "left")
    return texts.unionByName(held).select(*keys, "blob_hash", "bytes")


def write_snapshot(snapshot: DataFrame, files: DataFrame, blobs: DataFrame, target: str, export_id: str) -> None:
    """Manifest and payload as Parquet, partitioned by vault; rows with a reason are in neither. The
    manifest comes last, so a folder without one is an unfinished run."""
    snapshot_payload(snapshot, files, blobs).write.mode("overwrite").partitionBy("vault_id").parquet(f"{target}/{export_id}/payload")
    listed = snapshot.filter(F.col("reason").isNull()).select("vault_id", "path", "rev", "hash", "size", "source_type")
    listed.write.mode("overwrite").partitionBy("vault_id").parquet(f"{target}/{export_id}/manifest")


def read_snapshot(spark, target: str, export_id: str) -> tuple[DataFrame, DataFrame]:
    folder = f"{target}/{export_id}"
    return spark.read.parquet(f"{folder}/manifest"), spark.read.parquet(f"{folder}/payload")


def verify_snapshot(manifest: DataFrame, payload: DataFrame) -> DataFrame:
    """One row per path of either side with a reason, NULL where the bytes' size and hash are those listed."""
    keys = ["vault_id", "path"]
    have = payload.select(*keys, F.lit(True).alias("_have"), F.sha2("bytes", 256).alias("_hash"), F.octet_length("bytes").alias("_size"))
    listed = manifest.select(*keys, "hash", "size", F.lit(True).alias("_listed"))
    wrong = F.col("_hash").isNull() | (F.col("_hash") != F.col("hash")) | (F.col("_size") != F.col("size"))
    return listed.join(have, keys, "full_outer").select(
        *keys,
        F.when(F.col("_listed").isNull(), "not_listed").when(F.col("_have").isNull(), "missing").when(wrong, "content_mismatch").alias("reason"),
    )


def restore_snapshot(manifest: DataFrame, payload: DataFrame, epoch_start_ms: int, origin: str) -> DataFrame:
    """Rows of a new vault state at revision 1, only for a snapshot that verifies completely."""
    bad = verify_snapshot(manifest, payload).filter("reason is not null").select("vault_id").distinct()
    sound = manifest.join(bad, "vault_id", "left_anti")
    blob = F.col("source_type").endswith("blob")
    return sound.join(payload.select("vault_id", "path", "bytes", "blob_hash"), ["vault_id", "path"]).select(
        "vault_id", "path", F.lit(1).cast("long").alias("rev"), "hash", "size", F.when(blob, "blob").otherwise("text").alias("kind"),
        F.when(~blob, F.decode("bytes", "UTF-8")).alias("content"), "blob_hash", F.when(blob, F.col("bytes")).alias("blob_bytes"),
        F.lit(False).alias("deleted"), F.lit(epoch_start_ms).cast("long").alias("at_ms"), F.lit(origin).alias("origin"),
    )


def start_exports(requests: DataFrame, runs: DataFrame) -> DataFrame:
    """Outcome of export requests in ``arrival`` order; a vault has at most one active run.

    A request for a (vault, time) that has a run gets it. Otherwise the vault's active run answers it
    (``busy``). Without one, the vault's first such request is queued; later ones with its time get the same
    run (``existing``), all others find it busy.
    """
    same = runs.groupBy("vault_id", "created_at").agg(F.min("export_id").alias("_same"))
    active = (
        runs.filter(F.col("status").isin("queued", "uploading"))
        .groupBy("vault_id").agg(F.min_by("export_id", F.struct("created_at", "export_id")).alias("_active"))
    )
    out = requests.join(same, ["vault_id", "created_at"], "left").join(active, "vault_id", "left")
    # The opening request of a vault is found by an aggregate with map-side combine.
    opened = out.filter("_same IS NULL AND _active IS NULL").groupBy("vault_id").agg(
        F.min("arrival").alias("_first"), F.min_by("created_at", "arrival").alias("_at")
    )
    out = out.join(opened, "vault_id", "left")
    free = F.col("_same").isNull() & F.col("_active").isNull()
    outcome = (
        F.when(F.col("_same").isNotNull(), "existing").when(~free, "busy").when(F.col("arrival") == F.col("_first"), "queued")
        .when(F.col("created_at") == F.col("_at"), "existing").otherwise("busy")
    )
    fresh = F.concat_ws(":", "vault_id", F.col("_at").cast("string"))
    return out.select(*requests.columns, F.coalesce("_same", "_active", fresh).alias("export_id"), outcome.alias("outcome"))


def finish_exports(runs: DataFrame, results: DataFrame, pins: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Runs after ``results`` (export_id, status complete or failed) and the pins that remain.

    Only an active run can finish; a finished one keeps its first result. Its pins go in the same step.
    """
    last = results.filter(F.col("status").isin("complete", "failed")).groupBy("export_id").agg(F.min_by("status", "arrival").alias("_result"))
    done = runs.join(last, "export_id", "left").withColumn(
        "status", F.when(F.col("status").isin("queued", "uploading"), F.coalesce("_result", "status")).otherwise(F.col("status"))
    ).select(*runs.columns)
    return done, release_pins(pins, done)


def active_exports(runs: DataFrame) -> DataFrame:
    """Active runs with their 1-based place per vault by start time."""
    active = runs.filter(F.col("status").isin("queued", "uploading"))
    return prefix_scan(active, ["vault_id"], ["created_at", "export_id"], {"place": F.lit(1)})


def release_pins(pins: DataFrame, runs: DataFrame) -> DataFrame:
    """Pins that remain: those of runs not yet finished."""
    active = runs.filter(F.col("status").isin("queued", "uploading")).select("export_id")
    return pins.join(active, "export_id", "left_semi")


def export_results(runs: DataFrame) -> DataFrame:
    """Finished runs, newest first."""
    return runs.filter(F.col("status").isin("complete", "failed")).orderBy(F.col("created_at").desc(), "export_id")
