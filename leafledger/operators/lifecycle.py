"""Housekeeping: payload accounting, capacity, reachability, collection, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.identity import json_number, json_row, json_string
from ..session import cut_lineage, prefix_scan

# ---- payload accounting ----------------------------------------------------


def _flag(name: str) -> Column:
    return F.when(F.col(name), "1").otherwise("0")


def revision_bytes() -> Column:
    """UTF-8 length of a revision row as a JSON array in fixed column order."""
    text = [json_string(F.col(c)) for c in ("path", "hash", "kind", "content", "blob_hash", "origin")]
    path, digest, kind, content, blob, origin = text
    row = json_row(path, json_number(F.col("rev")), digest, json_number(F.col("size")), kind, content, blob, _flag("deleted"),
                   origin, json_number(F.col("at_ms")))
    return F.octet_length(row).cast("long")


def receipt_bytes() -> Column:
    row = json_row(*[json_string(F.col(c)) for c in ("client_id", "op_key", "fingerprint")], json_number(F.col("status")),
                   json_string(F.col("body")), json_number(F.col("at_ms")))
    return F.octet_length(row).cast("long")


def change_bytes() -> Column:
    row = json_row(
        json_number(F.col("seq")), json_string(F.col("op")), json_string(F.col("path")), json_number(F.col("rev")),
        json_string(F.col("hash")), json_string(F.col("from_path")), json_number(F.col("from_rev")),
        json_string(F.col("origin")), json_number(F.col("at_ms")),
    )
    return F.octet_length(row).cast("long")


def history_pressure(revisions: DataFrame, receipts: DataFrame, changes: DataFrame) -> DataFrame:
    """Logical bytes per vault and category, and their total."""
    rows = (
        revisions.select("vault_id", F.lit("revisions").alias("category"), revision_bytes().alias("b"))
        .unionByName(receipts.select("vault_id", F.lit("receipts").alias("category"), receipt_bytes().alias("b")))
        .unionByName(changes.select("vault_id", F.lit("changes").alias("category"), change_bytes().alias("b")))
    )
    part = {f"{c}_bytes": F.coalesce(F.sum(F.when(F.col("category") == c, F.col("b"))), F.lit(0)).cast("long")
            for c in ("revisions", "receipts", "changes")}
    return rows.groupBy("vault_id").agg(*[e.alias(n) for n, e in part.items()], F.sum("b").alias("pressure_bytes"))


CATEGORIES = ("revisions", "receipts", "changes")
_SIZES = {"revisions": revision_bytes, "receipts": receipt_bytes, "changes": change_bytes}


def counter_changes(added: list[DataFrame] = (), removed: list[DataFrame] = ()) -> DataFrame:
    """(vault_id, category, delta) of a batch: bytes of the revisions, receipts and changes (in this order) it adds and removes."""
    rows = None
    for sign, tables in ((1, added), (-1, removed)):
        for category, table in zip(CATEGORIES, tables):
            own = table.select("vault_id", F.lit(category).alias("category"), (sign * _SIZES[category]()).cast("long").alias("delta"))
            rows = own if rows is None else rows.unionByName(own)
    return rows.groupBy("vault_id", "category").agg(F.sum("delta").alias("delta"))


def merge_counters(counters: DataFrame | None, changes: DataFrame) -> DataFrame:
    """Counters (vault_id, category, bytes) after a batch; its cost follows the batch, not the history."""
    rows = changes.select("vault_id", "category", F.col("delta").alias("bytes"))
    if counters is not None:
        rows = rows.unionByName(counters.select("vault_id", "category", "bytes"))
    return rows.groupBy("vault_id", "category").agg(F.sum("bytes").alias("bytes"))


def pressure_of(counters: DataFrame) -> DataFrame:
    """The columns of :func:`history_pressure` from counters. A counter below zero is shown as NULL with the reason
    ``counter_underflow``: more was removed than ever added, and only a recount helps."""
    one = {c: F.coalesce(F.sum(F.when(F.col("category") == c, F.col("bytes"))), F.lit(0)) for c in CATEGORIES}
    out = counters.groupBy("vault_id").agg(*[e.cast("long").alias(f"{c}_bytes") for c, e in one.items()])
    bad = F.least(*[F.col(f"{c}_bytes") for c in CATEGORIES]) < 0
    total = sum((F.col(f"{c}_bytes") for c in CATEGORIES[1:]), F.col("revisions_bytes"))
    return out.withColumns({"pressure_bytes": F.when(~bad, total), "reason": F.when(bad, "counter_underflow")}).withColumns(
        {f"{c}_bytes": F.when(F.col(f"{c}_bytes") >= 0, F.col(f"{c}_bytes")) for c in CATEGORIES}
    )


def counter_differences(counters: DataFrame, revisions: DataFrame, receipts: DataFrame, changes: DataFrame) -> DataFrame:
    """Vaults and categories whose counter is not that of a full recount."""
    full = merge_counters(None, counter_changes([revisions, receipts, changes])).withColumnRenamed("bytes", "recounted")
    both = counters.join(full, ["vault_id", "category"], "full_outer").na.fill(0, ["bytes", "recounted"])
    return both.filter("bytes <> recounted")


# ---- blobs -----------------------------------------------------------------


def blob_references(files: DataFrame, revisions: DataFrame, live_only: bool) -> DataFrame:
    """References from live files and from revisions (all of them unless ``live_only``)."""
    current = files.filter(~F.col("deleted") & F.col("blob_hash").isNotNull())
    kept = revisions.filter(F.col("blob_hash").isNotNull())
    if live_only:
        kept = kept.filter(~F.col("deleted"))
    columns = ["vault_id", F.col("blob_hash").alias("hash"), "size"]
    return current.select(*columns).unionByName(kept.select(*columns))


def referenced_bytes(files: DataFrame, revisions: DataFrame) -> DataFrame:
    """Distinct referenced blob bytes; unknown (NULL) if two references disagree on a size."""
    sizes = blob_references(files, revisions, live_only=True).groupBy("vault_id", "hash").agg(
        F.min("size").alias("lo"), F.max("size").alias("hi")
    )
    return sizes.groupBy("vault_id").agg(
        F.count(F.lit(1)).alias("blobs"),
        F.count_if(F.col("lo") != F.col("hi")).alias("conflicts"),
        F.when(F.max(F.col("lo") != F.col("hi")), F.lit(None)).otherwise(F.sum("lo")).alias("referenced_bytes"),
    )


def blob_refs(files: DataFrame, revisions: DataFrame) -> DataFrame:
    """Registry of every blob ever published, with its size at the first reference."""
    puts = files.filter("blob_hash is not null").select("vault_id", F.col("blob_hash").alias("hash"), "size", F.col("updated_at").alias("at_ms"))
    puts = puts.unionByName(revisions.filter("blob_hash is not null and not deleted").select(
        "vault_id", F.col("blob_hash").alias("hash"), "size", "at_ms"))
    return puts.groupBy("vault_id", "hash").agg(
        F.min_by("size", F.struct("at_ms", "size")).alias("size"), F.min("at_ms").alias("first_ref_at")
    )


def capacity_report(files: DataFrame, registry: DataFrame, reduced: DataFrame | None = None) -> DataFrame:
    """Live files, registered blob bytes and attention codes per vault.

    The store size of the old single database is read here as bytes of live inline text.
    """
    live = files.filter(~F.col("deleted")).groupBy("vault_id").agg(
        F.count(F.lit(1)).alias("live_files"),
        F.coalesce(F.sum(F.when(F.col("kind") == "text", F.col("size"))), F.lit(0)).alias("store_bytes"),
    )
    blobs = registry.groupBy("vault_id").agg(F.sum("size").alias("blob_bytes"))
    out = live.join(blobs, "vault_id", "full_outer").na.fill(0, ["live_files", "store_bytes", "blob_bytes"])
    if reduced is None:
        return out.withColumn("attention", capacity_attention(F.lit(False)))
    out = out.join(reduced.select("vault_id", "history_reduced"), "vault_id", "left")
    return out.withColumn("attention", capacity_attention(F.coalesce("history_reduced", F.lit(False)))).drop("history_reduced")


def capacity_attention(reduced: Column) -> Column:
    """Codes at exact thresholds, in fixed order."""
    full = (F.col("store_bytes") >= K.DATABASE_LIMIT_BYTES) | (F.col("live_files") >= K.LIVE_FILE_LIMIT)
    return F.array_compact(
        F.array(
            F.when(F.col("store_bytes") >= K.DATABASE_ALERT_BYTES, "storage_high"),
            F.when(full, "capacity_exceeded"),
            F.when(reduced, "history_reduced"),
            F.when(F.col("blob_bytes") >= K.BLOB_ALERT_BYTES, "blob_storage_high"),
        )
    )


def reachable_hashes(files: DataFrame, revisions: DataFrame, exports: DataFrame, export_files: DataFrame) -> DataFrame:
    """Hashes owned by live files, by any retained revision (deleted ones too) or by an active export."""
    active = exports.filter(F.col("status").isin("queued", "uploading")).select("vault_id", "export_id")
    exported = (
        export_files.filter("source_type like '%blob'")
        .join(active, ["vault_id", "export_id"], "left_semi")
        .select("vault_id", "hash")
    )
    return blob_references(files, revisions, live_only=False).select("vault_id", "hash").unionByName(exported).distinct()


def gc_candidates(inventory: DataFrame, reachable: DataFrame) -> DataFrame:
    """Stored blobs that nothing reaches."""
    return inventory.join(reachable, ["vault_id", "hash"], "left_anti")


def gc_preview(inventory: DataFrame, reachable: DataFrame) -> DataFrame:
    return gc_candidates(inventory, reachable).groupBy("vault_id").agg(
        F.count(F.lit(1)).alias("blobs"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")
    )


def gc_mark(inventory: DataFrame, reachable: DataFrame, marks: DataFrame | None, now_ms: int) -> DataFrame:
    """All marks after a marking run: earlier ones keep their time."""
    fresh = gc_candidates(inventory, reachable).select("vault_id", "hash", "size", F.lit(now_ms).cast("long").alias("marked_at"))
    if marks is None:
        return fresh
    return marks.unionByName(fresh.join(marks.select("vault_id", "hash"), ["vault_id", "hash"], "left_anti"))


def gc_sweep(marks: DataFrame, reachable: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(blobs to delete, marks to drop because something refers to them again)."""
    return (
        marks.join(reachable, ["vault_id", "hash"], "left_anti"),
        marks.join(reachable, ["vault_id", "hash"], "left_semi"),
    )


def validate_inventory(inventory: DataFrame) -> DataFrame:
    """Rows of a blob listing with a reason where the hash is malformed, repeated or oversized."""
    copies = inventory.groupBy("vault_id", "hash").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return inventory.join(copies, ["vault_id", "hash"], "left").select(
        *inventory.columns,
        F.when(~F.col("hash").rlike("^[0-9a-f]{64}$"), "invalid_hash").when(F.col("_n").isNotNull(), "duplicate_hash")
        .when(~F.col("size").between(0, K.SAFE_INTEGER), "invalid_size").alias("reason"),
    )


# ---- retention --------------------------------------------------------------


def expired_rows(table: DataFrame, now_ms: int) -> DataFrame:
    """Rows older than the retention cut-off; a row exactly at it stays."""
    return table.filter(F.col("at_ms") < now_ms - K.RETENTION_DAYS * K.DAY_MS)


def kept_rows(table: DataFrame, now_ms: int) -> DataFrame:
    return table.filter(F.col("at_ms") >= now_ms - K.RETENTION_DAYS * K.DAY_MS)


def retention_plan(
    revisions: DataFrame, receipts: DataFrame, changes: DataFrame, pins: DataFrame, now_ms: int,
    limit_bytes: int = K.HISTORY_PRESSURE_LIMIT_BYTES,
) -> DataFrame:
    """Every revision with ``action``: ``expired``, ``pressure`` or ``keep``.

    Age first. Then, where a vault's remaining history exceeds the limit, the oldest
    unpinned rows past the seven-day floor go until the total fits. The running sum is
    taken over range slices, and only for vaults that are over the limit.
    """
    pinned = pins.select("vault_id", "path", "rev", F.lit(True).alias("_pin")).distinct()
    rows = (
        revisions.select("vault_id", "path", "rev", "at_ms", revision_bytes().alias("bytes"))
        .join(pinned, ["vault_id", "path", "rev"], "left")
        .withColumn("pinned", F.coalesce("_pin", F.lit(False))).drop("_pin")
        .withColumn("expired", (F.col("at_ms") < now_ms - K.RETENTION_DAYS * K.DAY_MS) & ~F.col("pinned"))
    )
    left = (
        rows.filter("not expired").select("vault_id", F.col("bytes").alias("b"))
        .unionByName(kept_rows(receipts, now_ms).select("vault_id", receipt_bytes().alias("b")))
        .unionByName(kept_rows(changes, now_ms).select("vault_id", change_bytes().alias("b")))
    )
    over = left.groupBy("vault_id").agg((F.sum("b") - limit_bytes).alias("excess")).filter("excess > 0")
    movable = (~F.col("expired")) & (~F.col("pinned")) & (F.col("at_ms") < now_ms - K.PRESSURE_FLOOR_DAYS * K.DAY_MS)
    # Rows of vaults within the limit skip the sort; the others carry what they need through it, so nothing is joined back.
    judged = rows.join(over, "vault_id", "left")
    freed = F.when(movable, F.col("bytes")).otherwise(0)
    running = prefix_scan(judged.filter("excess IS NOT NULL"), ["vault_id"], ["at_ms", "path", "rev"], {"before": freed}, exclusive=True)
    pressed = running.select("*", (movable & (F.col("before") < F.col("excess"))).alias("_prune"))
    calm = judged.filter("excess IS NULL").withColumns({"before": F.lit(0).cast("long"), "_prune": F.lit(False)})
    return pressed.unionByName(calm).select(
        "vault_id", "path", "rev", "at_ms", "bytes", "pinned",
        F.when(F.col("expired"), "expired").when(F.col("_prune"), "pressure").otherwise("keep").alias("action"),
    )


def apply_retention(revisions, receipts, changes, pins, now_ms, limit_bytes=K.HISTORY_PRESSURE_LIMIT_BYTES):
    """Kept tables plus, from the same plan, the new feed floor and the reduced flag per vault."""
    keys = ["vault_id", "path", "rev"]
    # Read by two of the outputs, so worked out once.
    plan = cut_lineage(retention_plan(revisions, receipts, changes, pins, now_ms, limit_bytes).select(*keys, "action"))
    gone = plan.filter("action <> 'keep'").select(*keys)
    floors = expired_rows(changes, now_ms).groupBy("vault_id").agg((F.max("seq") + 1).alias("pruned_floor"))
    reduced = plan.groupBy("vault_id").agg(F.max(F.col("action") == "pressure").alias("history_reduced"))
    return {
        "revisions": revisions.join(gone, keys, "left_anti"),
        "receipts": kept_rows(receipts, now_ms),
        "changes": kept_rows(changes, now_ms),
        "floors": floors,
        "reduced": reduced,
    }


def retention_summary(plan: DataFrame) -> DataFrame:
    return plan.groupBy("vault_id", "action").agg(F.count(F.lit(1)).alias("rows"), F.sum("bytes").alias("bytes"))
