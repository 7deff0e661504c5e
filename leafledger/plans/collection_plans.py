"""Registered queries: reference counts by change, the collection run, history counters by change."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import collection as C
from ..operators import device as D
from ..operators import exports as X
from ..operators import lifecycle as L
from ..session import written_table
from .catalog import Area
from .lifecycle_plans import _PRESSURE, _REACH_IN

AREA = Area()

# Revisions come in four batches and every tenth of them is pruned again.
_PRUNED = "(arrival - 1) % 10 = 3"
_COUNTED = {
    "referred": f"""SELECT vault_id, blob_hash AS hash FROM notes WHERE NOT deleted AND blob_hash IS NOT NULL
UNION ALL SELECT vault_id, blob_hash FROM revisions WHERE blob_hash IS NOT NULL AND NOT ({_PRUNED})
UNION ALL SELECT f.vault_id, f.hash FROM export_files f JOIN exports e ON e.export_id = f.export_id AND e.vault_id = f.vault_id
  WHERE e.status IN ('queued','uploading') AND f.source_type LIKE '%blob'""",
}


def _counts(notes, revisions, exports, export_files):
    """Counts after five batches of changes: files and exports, then revisions, one in ten of a batch leaving with the next."""
    counts = C.merge_counts(None, C.reference_changes([C.file_references(notes), C.export_references(exports, export_files)], []))
    batch = lambda k: revisions.filter(F.col("arrival") % 4 == k)
    for k in range(4):
        removed = [C.revision_references(batch(k - 1).filter(_PRUNED))] if k else []
        counts = C.merge_counts(counts, C.reference_changes([C.revision_references(batch(k))], removed))
    return C.merge_counts(counts, C.reference_changes([], [C.revision_references(batch(3).filter(_PRUNED))]))


@AREA.add("u1_counts_by_change", *_REACH_IN, steps=_COUNTED, sql="SELECT vault_id, hash, count(*) AS refs FROM referred GROUP BY vault_id, hash")
def _by_change(*tables):
    return _counts(*tables).filter("reason IS NULL").drop("reason")


@AREA.add(
    "t23_collection_run", "inventory", *_REACH_IN,
    steps=_COUNTED | {
        "loose": "SELECT i.vault_id, i.hash, i.size, i.hash < '8' AS low, substr(i.hash, 3, 1) < '8' AS early FROM inventory i ANTI JOIN referred r ON i.vault_id = r.vault_id AND i.hash = r.hash",
        "vaults": "SELECT DISTINCT vault_id FROM inventory",
        "steps": """SELECT v.vault_id, coalesce(max(CASE WHEN low THEN 1 ELSE 0 END), 0) AS a, coalesce(max(CASE WHEN NOT low THEN 1 ELSE 0 END), 0) AS b,
  coalesce(max(CASE WHEN early THEN 1 ELSE 0 END), 0) AS c, coalesce(max(CASE WHEN NOT early THEN 1 ELSE 0 END), 0) AS d
FROM vaults v LEFT JOIN loose l ON v.vault_id = l.vault_id GROUP BY v.vault_id""",
    },
    sql="""
SELECT 'refused' AS part, i.vault_id, i.hash, 'blob_gc_in_progress' AS note, CAST(0 AS BIGINT) AS generation
FROM inventory i JOIN steps s ON i.vault_id = s.vault_id LEFT JOIN loose l ON i.vault_id = l.vault_id AND i.hash = l.hash WHERE s.a = 1 OR coalesce(l.low, false)
UNION ALL SELECT 'deleted', vault_id, hash, CASE WHEN early THEN 'o1' ELSE 'o3' END, CAST(0 AS BIGINT) FROM loose
UNION ALL SELECT 'held', vault_id, NULL, 'o1', CAST(a + b AS BIGINT) FROM steps
UNION ALL SELECT 'retry', vault_id, NULL, 'blob_gc_unavailable', CAST(a + b + c AS BIGINT) FROM steps
UNION ALL SELECT 'end', vault_id, NULL, 'idle', CAST(a + b + c + d AS BIGINT) FROM steps""",
)
def _run(inventory, *tables):
    """A whole run of every vault: two requests, two pages one of which comes twice, publications between them, two claims
    at once, a deletion that fails half-way, and its retry by a third owner."""
    counts, inventory = written_table(_counts(*tables), "gc-counts"), written_table(inventory, "gc-inventory")
    vaults = written_table(inventory.select("vault_id").distinct().coalesce(1), "gc-vaults")
    rows = lambda **more: vaults.select("vault_id", *[F.lit(v).alias(n) for n, v in more.items()])
    runs = C.start_runs(C.idle_runs(vaults), rows(run_id="r2", arrival=2).unionByName(rows(run_id="r1", arrival=1)))
    marks = inventory.limit(0).select("vault_id", "hash", "size", F.lit(0).cast("long").alias("marked_at"))
    page = lambda run, at, cond: inventory.filter(cond).select("vault_id", "hash", "size", F.lit(run).alias("run_id"), F.lit(at).alias("cursor"))
    low, high = F.col("hash") < "8", F.col("hash") >= "8"
    runs, marks = C.mark_pages(runs, marks, counts, rows(run_id="r1", cursor="", next_cursor="8"), page("r1", "", low), 1_000)
    runs, marks = written_table(runs, "gc-runs"), written_table(marks, "gc-marks")
    refused = C.fence_publications(inventory.withColumn("observed_generation", F.lit(0).cast("long")), runs, marks).filter("reason IS NOT NULL")
    # The first page once more and a page of a run that was never started: both came too late.
    old = rows(run_id="r1", cursor="", next_cursor="8").unionByName(rows(run_id="r2", cursor="8", next_cursor="9"))
    runs, marks = C.mark_pages(runs, marks, counts, old, page("r1", "", low).unionByName(page("r2", "8", high)), 2_000)
    last = rows(run_id="r1", cursor="8").withColumn("next_cursor", F.lit(None).cast("string"))
    runs, marks = C.mark_pages(runs, marks, counts, last, page("r1", "8", high), 3_000)
    runs, marks = written_table(runs, "gc-runs"), written_table(marks, "gc-marks")
    runs = written_table(C.claim_deletes(runs, rows(owner="o2", arrival=2).unionByName(rows(owner="o1", arrival=1))), "gc-runs")
    held = runs
    mine = C.claimed_marks(runs, marks)
    first = written_table(mine.filter(F.substring("hash", 3, 1) < "8").select("vault_id", "owner", "hash", "size"), "gc-deleted")
    # The second claim's owner holds nothing, so what it reports is ignored.
    foreign = first.withColumn("owner", F.lit("o2")).unionByName(mine.select("vault_id", F.lit("o2").alias("owner"), "hash", "size"))
    settled = rows(owner="o1", failed=True).unionByName(rows(owner="o2", failed=False))
    runs, marks = C.settle_deletes(runs, marks, first.unionByName(foreign), settled)
    runs, marks = written_table(runs, "gc-runs"), written_table(marks, "gc-marks")
    retry = runs
    runs = written_table(C.claim_deletes(runs, rows(owner="o3", arrival=3)), "gc-runs")
    second = written_table(C.claimed_marks(runs, marks).select("vault_id", "owner", "hash", "size"), "gc-deleted")
    runs, marks = C.settle_deletes(runs, marks, second, rows(owner="o3", failed=False))
    end = C.finish_runs(runs, marks)
    shape = lambda df, part, digest, note, generation: df.select(
        F.lit(part).alias("part"), "vault_id", digest.cast("string").alias("hash"), note.alias("note"), generation.cast("long").alias("generation")
    )
    none, zero, now = F.lit(None), F.lit(0), F.col("generation")
    return (
        shape(refused, "refused", F.col("hash"), F.col("reason"), zero)
        .unionByName(shape(first.unionByName(second), "deleted", F.col("hash"), F.col("owner"), zero))
        .unionByName(shape(held, "held", none, F.col("owner"), now))
        .unionByName(shape(retry, "retry", none, F.col("failure"), now))
        .unionByName(shape(end, "end", none, F.col("phase"), now))
    )


@AREA.add(
    "a5_counters_by_change", "revisions", "receipts", "changes",
    steps=_PRESSURE,
    sql="""SELECT vault_id, CAST(coalesce(sum(b) FILTER (c = 'revisions'), 0) AS BIGINT) AS revisions_bytes, CAST(coalesce(sum(b) FILTER (c = 'receipts'), 0) AS BIGINT) AS receipts_bytes,
  CAST(coalesce(sum(b) FILTER (c = 'changes'), 0) AS BIGINT) AS changes_bytes, CAST(sum(b) AS BIGINT) AS pressure_bytes, CAST(NULL AS VARCHAR) AS reason
FROM sized GROUP BY vault_id""",
)
def _counters(revisions, receipts, changes):
    """Three batches of rows, the first of which is pruned and written again by the third."""
    part = lambda k: [t.filter(F.col(n) % 3 == k) for t, n in ((revisions, "arrival"), (receipts, "arrival"), (changes, "seq"))]
    counters = L.merge_counters(None, L.counter_changes(added=part(0)))
    counters = L.merge_counters(counters, L.counter_changes(added=part(1), removed=part(0)))
    counters = L.merge_counters(counters, L.counter_changes(added=part(2)))
    counters = L.merge_counters(counters, L.counter_changes(added=part(0)))
    return L.pressure_of(counters)


@AREA.add("o11_apply_order", "feed", sql="SELECT device_id, vault_id, seq, path, row_number() OVER (PARTITION BY device_id, vault_id ORDER BY seq) AS place FROM feed")
def _apply_order(feed):
    return D.apply_order(feed).select("device_id", "vault_id", "seq", "path", "place")


@AREA.add("o11_mark_order", "inventory", sql="SELECT vault_id, hash, size, row_number() OVER (PARTITION BY vault_id ORDER BY hash) AS place FROM inventory")
def _mark_order(inventory):
    return C.mark_order(inventory)


@AREA.add(
    "o11_export_order", "exports",
    sql="SELECT vault_id, export_id, created_at, row_number() OVER (PARTITION BY vault_id ORDER BY created_at, export_id) AS place FROM exports WHERE status IN ('queued', 'uploading')",
)
def _export_order(exports):
    return X.active_exports(exports).select("vault_id", "export_id", "created_at", "place")
