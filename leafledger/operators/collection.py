"""Collection of unreferenced blobs by counts kept per change, with a run state and a publication fence.

References are counted, not searched: every change adds signed rows, and a merge of counts and changes is one aggregate whose
cost follows the change. A hash without a positive count is unreferenced.

A vault's collection is one row of run state: ``phase`` goes from idle to marking to deleting and back. A page of the inventory is
applied only while its run and cursor are the current ones, so a page that two workers list is applied once. Marks and
deletions raise ``generation``; a publication that saw an older one, or names a marked hash, is refused and
tried again. Deletions are claimed by one owner at a time and settled only by that owner; what a failed deletion leaves stays
marked for the next claim.

All operators work on many vaults at once and return new tables; the caller writes them down between the steps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import prefix_scan

RUN = "vault_id string, phase string, run_id string, cursor string, generation long, owner string, delete_state string, failure string"
_RUN = [tuple(part.split()) for part in RUN.split(", ")]
# Fixed value: failure code of an interrupted or refused step.
UNAVAILABLE = "blob_gc_unavailable"
FENCED = "blob_gc_in_progress"

# ---- reference counts ----------------------------------------------------------


def file_references(files: DataFrame) -> DataFrame:
    """One reference per live file that names a blob."""
    return files.filter(~F.col("deleted") & F.col("blob_hash").isNotNull()).select("vault_id", F.col("blob_hash").alias("hash"))


def revision_references(revisions: DataFrame) -> DataFrame:
    """One reference per retained revision that names a blob, deleted ones too."""
    return revisions.filter(F.col("blob_hash").isNotNull()).select("vault_id", F.col("blob_hash").alias("hash"))


def export_references(exports: DataFrame, export_files: DataFrame) -> DataFrame:
    """One reference per blob of an active export."""
    active = exports.filter(F.col("status").isin("queued", "uploading")).select("vault_id", "export_id")
    return export_files.filter("source_type LIKE '%blob'").join(active, ["vault_id", "export_id"], "left_semi").select("vault_id", "hash")


def reference_changes(added: list[DataFrame], removed: list[DataFrame]) -> DataFrame:
    """(vault_id, hash, delta): what a change of state adds to and takes from the counts, summed per hash."""
    signed = [r.withColumn("delta", F.lit(1).cast("long")) for r in added] + [r.withColumn("delta", F.lit(-1).cast("long")) for r in removed]
    rows = signed[0]
    for more in signed[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy("vault_id", "hash").agg(F.sum("delta").alias("delta")).filter("delta <> 0")


def merge_counts(counts: DataFrame | None, changes: DataFrame) -> DataFrame:
    """Counts after a change: (vault_id, hash, refs, reason). Hashes at zero go; below zero ``reason`` is ``underflow``
    and the count stays as it is, for a recount to mend."""
    rows = changes.select("vault_id", "hash", F.col("delta").alias("refs"))
    if counts is not None:
        rows = rows.unionByName(counts.select("vault_id", "hash", "refs"))
    merged = rows.groupBy("vault_id", "hash").agg(F.sum("refs").alias("refs")).filter("refs <> 0")
    return merged.withColumn("reason", F.when(F.col("refs") < 0, "underflow"))


def count_differences(counts: DataFrame, references: list[DataFrame]) -> DataFrame:
    """Hashes whose kept count is not that of a full recount."""
    full = merge_counts(None, reference_changes(references, [])).select("vault_id", "hash", F.col("refs").alias("recounted"))
    both = counts.select("vault_id", "hash", "refs").join(full, ["vault_id", "hash"], "full_outer").na.fill(0, ["refs", "recounted"])
    return both.filter("refs <> recounted")


# ---- run state -----------------------------------------------------------------


def idle_runs(vaults: DataFrame) -> DataFrame:
    """State of vaults that were never collected."""
    state = {"phase": F.lit("idle"), "generation": F.lit(0).cast("long")}
    return vaults.select("vault_id").distinct().select(
        "vault_id", *[state.get(n, F.lit(None).cast(t)).alias(n) for n, t in _RUN[1:]]
    )


def _raise_generation(runs: DataFrame, vaults: DataFrame) -> DataFrame:
    """Generation plus one for each of ``vaults``."""
    moved = vaults.select("vault_id").distinct().withColumn("_moved", F.lit(True))
    return runs.join(moved, "vault_id", "left").withColumn("generation", F.col("generation") + F.when(F.col("_moved"), 1).otherwise(0)).drop("_moved")


def start_runs(runs: DataFrame, requests: DataFrame) -> DataFrame:
    """Marking begins for idle vaults with the first request (vault_id, run_id, arrival); other requests change nothing."""
    first = requests.groupBy("vault_id").agg(F.min_by("run_id", "arrival").alias("_id"))
    fresh = (F.col("phase") == "idle") & F.col("_id").isNotNull()
    return runs.join(first, "vault_id", "left").withColumns(
        {
            "run_id": F.when(fresh, F.col("_id")).otherwise(F.col("run_id")), "cursor": F.when(fresh, F.lit("")).otherwise(F.col("cursor")),
            "failure": F.when(~fresh, F.col("failure")), "phase": F.when(fresh, "marking").otherwise(F.col("phase")),
        }
    ).select([n for n, _ in _RUN])


def mark_pages(runs: DataFrame, marks: DataFrame, counts: DataFrame, pages: DataFrame, objects: DataFrame, now_ms: int) -> tuple[DataFrame, DataFrame]:
    """Runs and marks after inventory pages (vault_id, run_id, cursor, next_cursor) with their ``objects`` (also vault_id, hash, size).

    A page counts only if its run and cursor are its vault's current ones. Objects without a reference and
    without a mark are marked; the last page, whose next cursor is NULL, opens the deleting phase.
    """
    own = ["vault_id", "run_id", "cursor"]
    current = runs.filter("phase = 'marking'").select(own)
    turned = pages.join(current, own, "left_semi").groupBy(own).agg(F.min("next_cursor").alias("_next"), F.max(F.col("next_cursor").isNull()).alias("_last"))
    seen = objects.join(turned.select(own), own, "left_semi").select("vault_id", "hash", "size").distinct()
    loose = seen.join(counts.filter("refs > 0").select("vault_id", "hash"), ["vault_id", "hash"], "left_anti")
    fresh = loose.join(marks.select("vault_id", "hash"), ["vault_id", "hash"], "left_anti").withColumn("marked_at", F.lit(now_ms).cast("long"))
    moved = runs.join(turned.drop("run_id", "cursor"), "vault_id", "left").withColumns(
        {
            "phase": F.when(F.col("_last"), "deleting").otherwise(F.col("phase")),
            "cursor": F.when(F.col("_last"), F.lit("")).otherwise(F.coalesce("_next", "cursor")),
            "failure": F.when(F.col("_last").isNull(), F.col("failure")),
        }
    )
    return _raise_generation(moved, fresh).select([n for n, _ in _RUN]), marks.unionByName(fresh)


def claim_deletes(runs: DataFrame, claims: DataFrame) -> DataFrame:
    """The first claim (vault_id, owner, arrival) holds a deleting vault that nobody holds; others change nothing."""
    first = claims.groupBy("vault_id").agg(F.min_by("owner", "arrival").alias("_owner"))
    taken = (F.col("phase") == "deleting") & F.col("owner").isNull() & F.col("_owner").isNotNull()
    return runs.join(first, "vault_id", "left").withColumns(
        {"delete_state": F.when(taken, "active").otherwise(F.col("delete_state")), "owner": F.when(taken, F.col("_owner")).otherwise(F.col("owner"))}
    ).select([n for n, _ in _RUN])


def claimed_marks(runs: DataFrame, marks: DataFrame) -> DataFrame:
    """Marked blobs that the holders of active claims may delete."""
    held = runs.filter("phase = 'deleting' AND delete_state = 'active'").select("vault_id", "owner")
    return marks.join(held, "vault_id")


def interrupt_deletes(runs: DataFrame) -> DataFrame:
    """State after a restart: what an active claim had deleted is not known."""
    return runs.withColumn("delete_state", F.when(F.col("delete_state") == "active", "unknown").otherwise(F.col("delete_state")))


def settle_deletes(runs: DataFrame, marks: DataFrame, deleted: DataFrame, settled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Runs and marks after claims end: ``deleted`` (vault_id, owner, hash, size), ``settled`` (vault_id, owner, failed).

    Rows of an owner that does not hold the vault's claim are ignored. A mark goes only with its exact hash and size; a failed
    claim is released with a failure and without touching marks that it did not delete.
    """
    own = ["vault_id", "owner"]
    held = runs.filter("owner IS NOT NULL").select(own)
    ended = settled.join(held, own, "left_semi").groupBy(own).agg(F.max("failed").alias("_failed"))
    gone = deleted.join(ended.select(own), own, "left_semi").select("vault_id", "hash", "size").distinct()
    removed = marks.join(gone, ["vault_id", "hash", "size"], "left_semi")
    left = marks.join(gone, ["vault_id", "hash", "size"], "left_anti")
    over = F.col("_failed").isNotNull()
    released = runs.join(ended.drop("owner"), "vault_id", "left").withColumns(
        {
            "owner": F.when(~over, F.col("owner")), "delete_state": F.when(~over, F.col("delete_state")),
            "failure": F.when(~over, F.col("failure")).when(F.col("_failed"), F.lit(UNAVAILABLE)),
        }
    )
    return _raise_generation(released, removed).select([n for n, _ in _RUN]), left


def finish_runs(runs: DataFrame, marks: DataFrame) -> DataFrame:
    """Deleting vaults without a claim and without marks are idle again."""
    waiting = marks.select("vault_id").distinct().withColumn("_marks", F.lit(True))
    done = (F.col("phase") == "deleting") & F.col("owner").isNull() & F.col("_marks").isNull()
    return runs.join(waiting, "vault_id", "left").withColumns(
        {
            "phase": F.when(done, "idle").otherwise(F.col("phase")), "run_id": F.when(~done, F.col("run_id")),
            "cursor": F.when(~done, F.col("cursor")), "failure": F.when(~done, F.col("failure")),
        }
    ).select([n for n, _ in _RUN])


def fence_publications(publications: DataFrame, runs: DataFrame, marks: DataFrame) -> DataFrame:
    """Adds ``reason``: a publication (vault_id, hash, observed_generation) of a marked hash, or one that saw another generation, waits."""
    marked = marks.select("vault_id", "hash", F.lit(True).alias("_marked")).distinct()
    now = runs.select("vault_id", F.col("generation").alias("_now"))
    joined = publications.join(marked, ["vault_id", "hash"], "left").join(now, "vault_id", "left")
    stop = F.coalesce("_marked", F.lit(False)) | ~F.col("observed_generation").eqNullSafe(F.coalesce("_now", F.lit(0).cast("long")))
    return joined.withColumn("reason", F.when(stop, FENCED)).drop("_marked", "_now")


def mark_order(marks: DataFrame) -> DataFrame:
    """Marks with their 1-based place by hash, the order in which a vault's marks are deleted."""
    return prefix_scan(marks, ["vault_id"], ["hash"], {"place": F.lit(1)})


def collection_status(runs: DataFrame, marks: DataFrame) -> DataFrame:
    """Phase, marked blobs and bytes, delete state and failure per vault."""
    totals = marks.groupBy("vault_id").agg(F.count(F.lit(1)).alias("marked_count"), F.sum("size").alias("marked_bytes"))
    return runs.join(totals, "vault_id", "left").select(
        "vault_id", "phase", F.coalesce("marked_count", F.lit(0)).alias("marked_count"), F.coalesce("marked_bytes", F.lit(0)).alias("marked_bytes"),
        F.coalesce("delete_state", F.lit("idle")).alias("delete_state"), "failure", "generation",
    )
