"""Registered queries: accounting, reachability, collection, retention, snapshots, registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..operators import blobs as B
from ..operators import exports as X
from ..operators import lifecycle as L
from ..operators import registry as R
from ..operators.reads import vault_summary
from .catalog import Area

AREA = Area()

_REV_BYTES = """CAST(BLEN(concat('[', CAST(to_json(path) AS STRING), ',', CAST(rev AS STRING), ',"', hash, '",', CAST(size AS STRING), ',"', kind, '",',
  coalesce(CAST(to_json(content) AS STRING), 'null'), ',', CASE WHEN blob_hash IS NULL THEN 'null' ELSE concat('"', blob_hash, '"') END, ',',
  CASE WHEN deleted THEN '1' ELSE '0' END, ',"', origin, '",', CAST(at_ms AS STRING), ']')) AS BIGINT)"""
_REC_BYTES = """CAST(BLEN(concat('["', client_id, '","', op_key, '","', fingerprint, '",', CAST(status AS STRING), ',', CAST(to_json(body) AS STRING), ',',
  CAST(at_ms AS STRING), ']')) AS BIGINT)"""
_CHG_BYTES = """CAST(BLEN(concat('[', CAST(seq AS STRING), ',"', op, '",', CAST(to_json(path) AS STRING), ',', CAST(rev AS STRING), ',"', hash,
  '",null,null,"', origin, '",', CAST(at_ms AS STRING), ']')) AS BIGINT)"""
_PRESSURE = {
    "sized": f"""SELECT vault_id, 'revisions' AS c, {_REV_BYTES} AS b FROM revisions
UNION ALL SELECT vault_id, 'receipts', {_REC_BYTES} FROM receipts UNION ALL SELECT vault_id, 'changes', {_CHG_BYTES} FROM changes""",
}


@AREA.add(
    "a5_history_pressure", "revisions", "receipts", "changes", steps=_PRESSURE,
    sql="""SELECT vault_id, CAST(sum(b) FILTER (c = 'revisions') AS BIGINT) AS revisions_bytes, CAST(sum(b) FILTER (c = 'receipts') AS BIGINT) AS receipts_bytes,
  CAST(sum(b) FILTER (c = 'changes') AS BIGINT) AS changes_bytes, CAST(sum(b) AS BIGINT) AS pressure_bytes FROM sized GROUP BY vault_id""",
)
def _pressure(revisions, receipts, changes):
    return L.history_pressure(revisions, receipts, changes)


@AREA.add(
    "a3_referenced_bytes", "notes", "revisions",
    steps={
        "refs": """SELECT vault_id, blob_hash AS hash, size FROM notes WHERE NOT deleted AND blob_hash IS NOT NULL
UNION ALL SELECT vault_id, blob_hash, size FROM revisions WHERE NOT deleted AND blob_hash IS NOT NULL""",
        "sizes": "SELECT vault_id, hash, min(size) AS lo, max(size) AS hi FROM refs GROUP BY vault_id, hash",
    },
    sql="""SELECT vault_id, count(*) AS blobs, count(*) FILTER (lo <> hi) AS conflicts,
  CASE WHEN max(CASE WHEN lo <> hi THEN 1 ELSE 0 END) = 1 THEN NULL ELSE CAST(sum(lo) AS BIGINT) END AS referenced_bytes FROM sizes GROUP BY vault_id""",
)
def _referenced(notes, revisions):
    return L.referenced_bytes(notes, revisions)


_REGISTRY = {
    "puts": """SELECT vault_id, blob_hash AS hash, size, updated_at AS at_ms FROM notes WHERE blob_hash IS NOT NULL
UNION ALL SELECT vault_id, blob_hash, size, at_ms FROM revisions WHERE blob_hash IS NOT NULL AND NOT deleted""",
    "registry": "SELECT vault_id, hash, arg_min(size, {'a': at_ms, 's': size}) AS size, min(at_ms) AS first_ref_at FROM puts GROUP BY vault_id, hash",
}


_ATTENTION = f"""concat_ws(',', CASE WHEN store_bytes >= {K.DATABASE_ALERT_BYTES} THEN 'storage_high' END,
  CASE WHEN store_bytes >= {K.DATABASE_LIMIT_BYTES} OR live_files >= {K.LIVE_FILE_LIMIT} THEN 'capacity_exceeded' END,
  CASE WHEN reduced THEN 'history_reduced' END, CASE WHEN blob_bytes >= {K.BLOB_ALERT_BYTES} THEN 'blob_storage_high' END)"""


@AREA.add(
    "a6_attention_codes", "notes",
    steps={"scaled": "SELECT vault_id, path, size * 700000 AS store_bytes, seq * 20 AS live_files, size * 1500000 AS blob_bytes, seq % 3 = 0 AS reduced FROM notes"},
    sql=f"SELECT vault_id, path, {_ATTENTION} AS attention FROM scaled",
)
def _attention(notes):
    """Every note stands for a vault of many times its size, so that all codes and thresholds occur."""
    scaled = notes.select("vault_id", "path", (F.col("size") * 700_000).alias("store_bytes"), (F.col("seq") * 20).alias("live_files"),
                          (F.col("size") * 1_500_000).alias("blob_bytes"), (F.col("seq") % 3 == 0).alias("reduced"))
    return scaled.select("vault_id", "path", F.array_join(L.capacity_attention(F.col("reduced")), ",").alias("attention"))


@AREA.add("s11_blob_registry", "notes", "revisions", steps=_REGISTRY, sql="SELECT * FROM registry")
def _registry(notes, revisions):
    return L.blob_refs(notes, revisions)


@AREA.add(
    "a4_a6_capacity_report", "notes", "revisions", steps=_REGISTRY,
    sql=f"""SELECT n.vault_id, n.live_files, n.store_bytes, b.blob_bytes, {_ATTENTION.replace('reduced', 'false')} AS attention
FROM (SELECT vault_id, count(*) AS live_files, CAST(sum(CASE WHEN kind = 'text' THEN size ELSE 0 END) AS BIGINT) AS store_bytes FROM notes WHERE NOT deleted GROUP BY vault_id) n
JOIN (SELECT vault_id, CAST(sum(size) AS BIGINT) AS blob_bytes FROM registry GROUP BY vault_id) b ON n.vault_id = b.vault_id""",
)
def _capacity(notes, revisions):
    return L.capacity_report(notes, L.blob_refs(notes, revisions)).withColumn("attention", F.array_join("attention", ","))


_REACHABLE = {
    "reachable": """SELECT vault_id, blob_hash AS hash FROM notes WHERE NOT deleted AND blob_hash IS NOT NULL
UNION SELECT vault_id, blob_hash FROM revisions WHERE blob_hash IS NOT NULL
UNION SELECT f.vault_id, f.hash FROM export_files f JOIN exports e ON e.export_id = f.export_id AND e.vault_id = f.vault_id
  WHERE e.status IN ('queued','uploading') AND f.source_type LIKE '%blob'""",
    "loose": "SELECT i.* FROM inventory i ANTI JOIN reachable r ON i.vault_id = r.vault_id AND i.hash = r.hash",
}
_REACH_IN = ("notes", "revisions", "exports", "export_files")


@AREA.add("u2_reachable_hashes", *_REACH_IN, steps=_REACHABLE, sql="SELECT * FROM reachable")
def _reachable(*tables):
    return L.reachable_hashes(*tables)


@AREA.add(
    "u1_blob_references", "notes", "revisions",
    sql="""SELECT vault_id, hash, size, count(*) AS refs FROM (SELECT vault_id, blob_hash AS hash, size FROM notes WHERE NOT deleted AND blob_hash IS NOT NULL
UNION ALL SELECT vault_id, blob_hash, size FROM revisions WHERE blob_hash IS NOT NULL) t GROUP BY ALL""",
)
def _references(notes, revisions):
    return L.blob_references(notes, revisions, live_only=False).groupBy("vault_id", "hash", "size").agg(F.count(F.lit(1)).alias("refs"))


@AREA.add("j4_gc_candidates", "inventory", *_REACH_IN, steps=_REACHABLE, sql="SELECT * FROM loose")
def _candidates(inventory, *tables):
    return L.gc_candidates(inventory, L.reachable_hashes(*tables))


@AREA.add("a7_gc_preview", "inventory", *_REACH_IN, steps=_REACHABLE, sql="SELECT vault_id, count(*) AS blobs, CAST(sum(size) AS BIGINT) AS bytes FROM loose GROUP BY vault_id")
def _preview(inventory, *tables):
    return L.gc_preview(inventory, L.reachable_hashes(*tables))


@AREA.add(
    "t23_gc_cycle", "inventory", "notes", "revisions", "exports", "export_files",
    steps=_REACHABLE | {
        "early": "SELECT i.vault_id, i.hash, i.size, 1000 AS marked_at FROM inventory i WHERE substr(i.hash, 1, 1) IN ('0','1')",
        "marks": "SELECT * FROM early UNION ALL SELECT l.vault_id, l.hash, l.size, 2000 FROM loose l ANTI JOIN early e ON l.vault_id = e.vault_id AND l.hash = e.hash",
    },
    sql="""SELECT m.vault_id, m.hash, m.size, CAST(m.marked_at AS BIGINT) AS marked_at, CASE WHEN r.hash IS NULL THEN 'delete' ELSE 'unmark' END AS action
FROM marks m LEFT JOIN reachable r ON m.vault_id = r.vault_id AND m.hash = r.hash""",
)
def _gc(inventory, *tables):
    reachable = L.reachable_hashes(*tables)
    early = inventory.filter(F.substring("hash", 1, 1).isin("0", "1")).withColumn("marked_at", F.lit(1000).cast("long"))
    marks = L.gc_mark(inventory, reachable, early, 2000)
    delete, unmark = L.gc_sweep(marks, reachable)
    return delete.withColumn("action", F.lit("delete")).unionByName(unmark.withColumn("action", F.lit("unmark")))


_RETAIN_NOW = 1706745600000 + 15 * 86_400_000
_RETAIN_LIMIT = 600_000
_PLAN = _PRESSURE | {
    "rows_": f"""SELECT r.vault_id, r.path, r.rev, r.at_ms, {_REV_BYTES.replace('vault_id', 'r.vault_id')} AS bytes FROM revisions r""",
    "flagged": f"""SELECT w.*, p.path IS NOT NULL AS pinned, w.at_ms < {_RETAIN_NOW} - 2592000000 AND p.path IS NULL AS expired
FROM rows_ w LEFT JOIN pins p ON w.vault_id = p.vault_id AND w.path = p.path AND w.rev = p.rev""",
    "remaining": f"""SELECT vault_id, sum(b) AS total FROM (SELECT vault_id, bytes AS b FROM flagged WHERE NOT expired
UNION ALL SELECT vault_id, {_REC_BYTES} FROM receipts WHERE at_ms >= {_RETAIN_NOW} - 2592000000
UNION ALL SELECT vault_id, {_CHG_BYTES} FROM changes WHERE at_ms >= {_RETAIN_NOW} - 2592000000) t GROUP BY vault_id""",
    "run": f"""SELECT f.*, r.total - {_RETAIN_LIMIT} AS excess, coalesce(sum(bytes) OVER (PARTITION BY f.vault_id ORDER BY at_ms, path, rev
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
FROM flagged f JOIN remaining r ON f.vault_id = r.vault_id WHERE NOT expired AND NOT pinned AND at_ms < {_RETAIN_NOW} - 604800000""",
}


_ACTIONS = """SELECT f.vault_id, f.path, f.rev, f.at_ms, f.bytes, f.pinned, CASE WHEN f.expired THEN 'expired' WHEN r.before < r.excess THEN 'pressure' ELSE 'keep' END AS action
FROM flagged f LEFT JOIN run r ON f.vault_id = r.vault_id AND f.path = r.path AND f.rev = r.rev"""


@AREA.add("t15_w8_retention_plan", "revisions", "receipts", "changes", "pins", steps=_PLAN, sql=_ACTIONS)
def _retention(revisions, receipts, changes, pins):
    return L.retention_plan(revisions, receipts, changes, pins, _RETAIN_NOW, _RETAIN_LIMIT)


@AREA.add(
    "t15_apply_retention", "revisions", "receipts", "changes", "pins", steps=_PLAN | {"planned": _ACTIONS},
    sql=f"""SELECT 'changes' AS part, vault_id, count(*) AS rows FROM changes WHERE at_ms >= {_RETAIN_NOW} - 2592000000 GROUP BY vault_id
UNION ALL SELECT 'receipts', vault_id, count(*) FROM receipts WHERE at_ms >= {_RETAIN_NOW} - 2592000000 GROUP BY vault_id
UNION ALL SELECT 'floor', vault_id, max(seq) + 1 FROM changes WHERE at_ms < {_RETAIN_NOW} - 2592000000 GROUP BY vault_id
UNION ALL SELECT 'revisions', vault_id, count(*) FROM planned WHERE action = 'keep' GROUP BY vault_id
UNION ALL SELECT 'reduced', vault_id, CAST(max(CASE WHEN action = 'pressure' THEN 1 ELSE 0 END) AS BIGINT) FROM planned GROUP BY vault_id""",
)
def _apply_retention(revisions, receipts, changes, pins):
    kept = L.apply_retention(revisions, receipts, changes, pins, _RETAIN_NOW, _RETAIN_LIMIT)
    counts = [kept[t].groupBy("vault_id").agg(F.count(F.lit(1)).alias("rows")).withColumn("part", F.lit(t)) for t in ("changes", "receipts", "revisions")]
    floors = kept["floors"].select("vault_id", F.col("pruned_floor").alias("rows"), F.lit("floor").alias("part"))
    reduced = kept["reduced"].select("vault_id", F.col("history_reduced").cast("long").alias("rows"), F.lit("reduced").alias("part"))
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(floors).unionByName(reduced)


@AREA.add(
    "j3_unpinned_revisions", "revisions", "pins",
    sql="SELECT r.vault_id, r.path, r.rev FROM revisions r ANTI JOIN pins p ON r.vault_id = p.vault_id AND r.path = p.path AND r.rev = p.rev",
)
def _unpinned(revisions, pins):
    return revisions.join(pins, ["vault_id", "path", "rev"], "left_anti").select("vault_id", "path", "rev")


@AREA.add(
    "j5_active_export_files", "export_files", "exports",
    sql="""SELECT f.export_id, f.vault_id, f.path, f.hash, e.status FROM export_files f JOIN exports e ON f.export_id = e.export_id AND f.vault_id = e.vault_id
WHERE e.status IN ('queued','uploading')""",
)
def _active_files(export_files, exports):
    active = exports.filter(F.col("status").isin("queued", "uploading")).select("export_id", "vault_id", "status")
    return export_files.join(active, ["export_id", "vault_id"]).select("export_id", "vault_id", "path", "hash", "status")


# Revisions that agree with the notes, except where the hash starts with 'a' (size) or 'b' (pruned).
_SNAP = {
    "revs": """SELECT vault_id, path, rev, hash, CASE WHEN substr(hash,1,1) = 'a' THEN size + 1 ELSE size END AS size, kind, content, blob_hash, deleted
FROM notes WHERE substr(hash,1,1) <> 'b'""",
    "snap": """SELECT n.vault_id, n.path, n.rev, n.hash, n.size, concat(CASE WHEN r.hash IS NULL THEN 'snapshot_' ELSE 'revision_' END, n.kind) AS source_type,
  CASE WHEN r.size <> n.size THEN 'revision_mismatch' END AS reason
FROM notes n LEFT JOIN revs r ON n.vault_id = r.vault_id AND n.path = r.path AND n.rev = r.rev WHERE NOT n.deleted""",
}


def _snapshot(notes):
    first = F.substring("hash", 1, 1)
    revs = notes.filter(first != "b").withColumn("size", F.when(first == "a", F.col("size") + 1).otherwise(F.col("size")))
    return X.capture_snapshot(notes, revs)


@AREA.add("j2_capture_snapshot", "notes", steps=_SNAP, sql="SELECT * FROM snap")
def _capture(notes):
    return _snapshot(notes)


@AREA.add("w7_snapshot_ordinals", "notes", steps=_SNAP, sql="SELECT *, row_number() OVER (PARTITION BY vault_id ORDER BY encode(path)) - 1 AS ordinal FROM snap")
def _ordinals(notes):
    return X.snapshot_ordinals(_snapshot(notes))


@AREA.add(
    "a13_snapshot_checks", "notes", steps=_SNAP,
    sql="""SELECT vault_id, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, count(reason) AS bad_rows, count(*) AS live,
  CASE WHEN count(reason) > 0 THEN 'source_failure' ELSE 'ok' END AS verdict FROM snap GROUP BY vault_id""",
)
def _checks(notes):
    return X.snapshot_checks(_snapshot(notes), vault_summary(notes))


def _blob_store(documents):
    """Every document's bytes under their hash, in all vaults."""
    return documents.select(F.explode(F.array(*[F.lit(f"v{k}") for k in range(3)])).alias("vault_id"), F.sha2("text", 256).alias("hash"),
                            F.encode("text", "UTF-8").alias("content"))


@AREA.add(
    "s9_snapshot_payload", "notes", "documents",
    sql="""SELECT n.vault_id, n.path, n.rev, n.blob_hash, SHA(d.text) AS bytes_hash, CAST(BLEN(d.text) AS INT) AS bytes
FROM notes n JOIN documents d ON n.seq = d.doc_id + 1 WHERE NOT n.deleted""",
)
def _payload(notes, documents):
    """Texts and blobs as they would be written, every byte hashed."""
    out = X.snapshot_payload(X.capture_snapshot(notes, notes), notes, _blob_store(documents))
    return out.select("vault_id", "path", "rev", "blob_hash", F.sha2("bytes", 256).alias("bytes_hash"), F.octet_length("bytes").alias("bytes"))


@AREA.add(
    "s10_verify_snapshot", "notes", "documents",
    sql="""SELECT vault_id, path, CASE substr(hash,1,1) WHEN '0' THEN 'missing' WHEN '1' THEN 'content_mismatch' WHEN '2' THEN 'content_mismatch'
  WHEN '3' THEN 'content_mismatch' END AS reason FROM notes WHERE NOT deleted""",
)
def _verify(notes, documents):
    """Lost rows, altered, short and absent bytes of texts and blobs are found out path by path."""
    manifest = X.capture_snapshot(notes, notes)
    payload = X.snapshot_payload(manifest, notes, _blob_store(documents)).join(notes.select("vault_id", "path", F.substring("hash", 1, 1).alias("k")), ["vault_id", "path"])
    spoilt = (
        F.when(F.col("k") == "1", F.concat("bytes", F.lit("!").cast("binary")))
        .when(F.col("k") == "2", F.expr("substring(bytes, 1, octet_length(bytes) - 1)"))
        .when(F.col("k") == "3", F.lit(None).cast("binary")).otherwise(F.col("bytes"))
    )
    return X.verify_snapshot(manifest, payload.filter("k <> '0'").withColumn("bytes", spoilt))


@AREA.add(
    "s10_restore_snapshot", "notes", "documents",
    sql="""SELECT vault_id, path, CAST(1 AS BIGINT) AS rev, hash, size, kind, CAST(BLEN(content) AS INT) AS bytes,
  CASE WHEN kind = 'blob' THEN hash END AS blob_bytes_hash FROM notes WHERE NOT deleted""",
)
def _restore(notes, documents):
    manifest = X.capture_snapshot(notes, notes)
    rows = X.restore_snapshot(manifest, X.snapshot_payload(manifest, notes, _blob_store(documents)), 0, "restore")
    return rows.select("vault_id", "path", "rev", "hash", "size", "kind", F.octet_length("content").alias("bytes"), F.sha2("blob_bytes", 256).alias("blob_bytes_hash"))


_ASKED = {
    "asked": "SELECT o_orderkey, o_orderkey AS arrival, concat('v', CAST(o_custkey % 5 AS STRING)) AS vault_id, 1704067200000 + (o_orderkey % 30) * 3600000 AS created_at FROM orders",
    "active": "SELECT vault_id, arg_min(export_id, {'c': created_at, 'e': export_id}) AS export_id FROM exports WHERE status IN ('queued','uploading') GROUP BY vault_id",
    "matched": """SELECT a.*, s.export_id AS same_id, c.export_id AS active_id,
  arg_min(a.created_at, a.arrival) FILTER (s.export_id IS NULL AND c.export_id IS NULL) OVER (PARTITION BY a.vault_id) AS first_at,
  min(a.arrival) FILTER (s.export_id IS NULL AND c.export_id IS NULL) OVER (PARTITION BY a.vault_id) AS first_arrival
FROM asked a LEFT JOIN exports s ON a.vault_id = s.vault_id AND a.created_at = s.created_at LEFT JOIN active c ON a.vault_id = c.vault_id""",
}


@AREA.add(
    "t24_start_exports", "orders", "exports", steps=_ASKED,
    sql="""SELECT o_orderkey, arrival, vault_id, created_at, coalesce(same_id, active_id, concat(vault_id, ':', CAST(first_at AS STRING))) AS export_id,
  CASE WHEN same_id IS NOT NULL THEN 'existing' WHEN active_id IS NOT NULL THEN 'busy' WHEN arrival = first_arrival THEN 'queued'
    WHEN created_at = first_at THEN 'existing' ELSE 'busy' END AS outcome FROM matched""",
)
def _start(orders, exports):
    asked = orders.select(
        "o_orderkey", F.col("o_orderkey").alias("arrival"), F.concat(F.lit("v"), F.col("o_custkey") % 5).alias("vault_id"),
        (F.lit(1704067200000) + F.col("o_orderkey") % 30 * 3600000).alias("created_at"),
    )
    return X.start_exports(asked, exports)


@AREA.add(
    "t24_finish_exports", "exports", "pins", "orders",
    steps={
        "told": "SELECT concat('x', CAST(o_orderkey % 40 AS STRING)) AS export_id, CASE WHEN o_orderkey % 3 = 0 THEN 'complete' WHEN o_orderkey % 3 = 1 THEN 'failed' ELSE 'paused' END AS status, o_orderkey AS arrival FROM orders WHERE o_orderkey % 4 = 1",
        "result": "SELECT export_id, arg_min(status, arrival) AS status FROM told WHERE status <> 'paused' GROUP BY export_id",
        "done": "SELECT e.export_id, e.vault_id, CASE WHEN e.status IN ('queued','uploading') THEN coalesce(r.status, e.status) ELSE e.status END AS status FROM exports e LEFT JOIN result r ON e.export_id = r.export_id",
        "pinned": "SELECT path, concat('x', CAST(rev % 25 AS STRING)) AS export_id FROM pins p",
    },
    sql="""SELECT d.export_id, d.vault_id, d.status, count(p.path) AS pins FROM done d
LEFT JOIN pinned p ON p.export_id = d.export_id AND d.status IN ('queued','uploading') GROUP BY d.export_id, d.vault_id, d.status""",
)
def _finish(exports, pins, orders):
    """Results for some runs, repeated and unknown ones among them; pins of finished runs go."""
    key = F.col("o_orderkey")
    told = orders.filter(key % 4 == 1).select(
        F.concat(F.lit("x"), key % 40).alias("export_id"), F.when(key % 3 == 0, "complete").when(key % 3 == 1, "failed").otherwise("paused").alias("status"),
        key.alias("arrival"),
    )
    done, left = X.finish_exports(exports, told, pins.withColumn("export_id", F.concat(F.lit("x"), F.col("rev") % 25)))
    held = left.groupBy("export_id").agg(F.count("path").alias("pins"))
    return done.join(held, "export_id", "left").select("export_id", "vault_id", "status", F.coalesce("pins", F.lit(0)).alias("pins"))


@AREA.add(
    "t24_release_pins", "pins", "exports",
    sql="SELECT p.* FROM (SELECT vault_id, path, rev, concat('x', CAST(rev % 25 AS STRING)) AS export_id FROM pins) p JOIN exports e ON p.export_id = e.export_id WHERE e.status IN ('queued','uploading')",
)
def _release(pins, exports):
    spread = pins.withColumn("export_id", F.concat(F.lit("x"), F.col("rev") % 25))
    return X.release_pins(spread, exports).select("vault_id", "path", "rev", "export_id")


@AREA.add("o8_export_results", "exports", sql="SELECT * FROM exports WHERE status IN ('complete','failed')")
def _results(exports):
    return X.export_results(exports)


@AREA.add(
    "j7_a8_client_registry", "clients", "grants", "revoked",
    steps={"held": "SELECT g.client_id, g.cleanup_pending, r.grant_id IS NULL AS active FROM grants g LEFT JOIN revoked r ON g.grant_id = r.grant_id"},
    sql="""SELECT c.vault_id, c.client_id, c.name, c.generation, c.created_at, c.last_seen_at, count(h.client_id) AS grant_count,
  count(*) FILTER (h.active) AS active_grant_count, count(*) FILTER (h.cleanup_pending) AS cleanup_pending,
  CASE WHEN count(*) FILTER (h.active) > 0 THEN 0 WHEN count(h.client_id) = 0 THEN 1 ELSE 2 END AS position
FROM clients c LEFT JOIN held h ON c.client_id = h.client_id GROUP BY ALL""",
)
def _clients(clients, grants, revoked):
    return R.client_registry(clients, grants, revoked)


@AREA.add(
    "t21_revoke_clients", "clients", "grants", "revoked", "consents",
    steps={"target": "SELECT client_id FROM clients WHERE substr(name, length(name), 1) IN ('3','7')"},
    sql="""SELECT 'client' AS part, c.client_id AS id, c.generation + CASE WHEN t.client_id IS NULL THEN 0 ELSE 1 END AS value FROM clients c LEFT JOIN target t ON c.client_id = t.client_id
UNION ALL SELECT 'grant', g.grant_id, CASE WHEN g.cleanup_pending OR (t.client_id IS NOT NULL AND r.grant_id IS NULL) THEN 1 ELSE 0 END
  FROM grants g LEFT JOIN target t ON g.client_id = t.client_id LEFT JOIN revoked r ON g.grant_id = r.grant_id
UNION ALL SELECT 'revoked', grant_id, at_ms FROM revoked
UNION ALL SELECT 'revoked', g.grant_id, 5000 FROM grants g JOIN target t ON g.client_id = t.client_id ANTI JOIN revoked r ON g.grant_id = r.grant_id
UNION ALL SELECT 'consent', c.consent_id, c.created_at FROM consents c ANTI JOIN target t ON c.client_id = t.client_id""",
)
def _revoke(clients, grants, revoked, consents):
    target = clients.filter(F.right("name", F.lit(1)).isin("3", "7")).select("client_id")
    after = R.revoke_clients(target, clients, grants, revoked, consents, 5000)

    def part(name, table, key, value):
        return after[table].select(F.lit(name).alias("part"), F.col(key).alias("id"), value.cast("long").alias("value"))

    return (
        part("client", "clients", "client_id", F.col("generation"))
        .unionByName(part("grant", "grants", "grant_id", F.col("cleanup_pending")))
        .unionByName(part("revoked", "revoked", "grant_id", F.col("at_ms")))
        .unionByName(part("consent", "consents", "consent_id", F.col("created_at")))
    )


_SWEEP_NOW = 1704250300000


@AREA.add(
    "t22_stale_clients", "clients", "grants", "consents",
    sql=f"""SELECT c.vault_id, c.client_id FROM clients c WHERE c.created_at < {_SWEEP_NOW} - 86400000
  AND NOT EXISTS (SELECT 1 FROM grants g WHERE g.client_id = c.client_id)
  AND NOT EXISTS (SELECT 1 FROM consents n WHERE n.client_id = c.client_id AND n.created_at > {_SWEEP_NOW} - 600000)""",
)
def _stale(clients, grants, consents):
    return R.stale_clients(clients, grants, consents, _SWEEP_NOW)


@AREA.add(
    "t22_removable_clients", "clients", "grants", "revoked",
    sql="""SELECT c.vault_id, c.client_id FROM clients c WHERE c.generation > 0 AND NOT EXISTS (SELECT 1 FROM grants g LEFT JOIN revoked r ON g.grant_id = r.grant_id
  WHERE g.client_id = c.client_id AND (g.cleanup_pending OR r.grant_id IS NULL))""",
)
def _removable(clients, grants, revoked):
    return R.removable_clients(clients, grants, revoked)


@AREA.add(
    "s8_verify_blob_bytes", "pages",
    sql="""SELECT concat('v', CAST(page_id % 3 AS STRING)) AS vault_id, SHA(html) AS hash, CASE WHEN page_id % 5 = 0 THEN 'blob_storage_unavailable'
  WHEN page_id % 5 IN (1, 2) THEN 'blob_integrity_mismatch' END AS reason,
  CASE WHEN page_id % 5 > 2 THEN SHA(html) END AS bytes_hash FROM pages""",
)
def _verify_blobs(pages):
    """Every stored page: some lost, some altered, some with a wrong declared size."""
    fifth = F.col("page_id") % 5
    rows = pages.select(fifth.alias("k"), F.concat(F.lit("v"), F.col("page_id") % 3).alias("vault_id"), F.sha2("html", 256).alias("hash"),
                        F.encode("html", "UTF-8").alias("raw"))
    stored = rows.filter("k <> 0").select("vault_id", "hash", F.when(F.col("k") == 1, F.concat("raw", F.lit("!").cast("binary"))).otherwise(F.col("raw")).alias("content"))
    size = F.octet_length("raw").cast("long") + F.when(F.col("k") == 2, 1).otherwise(0)
    out = B.verify_blob_bytes(stored, rows.select("vault_id", "hash", size.alias("size")))
    read = F.col("reason").isNull()
    return out.select("vault_id", "hash", "reason", F.when(read, F.sha2("bytes", 256)).alias("bytes_hash"))


@AREA.add(
    "s8_range_reads", "pages",
    sql="""SELECT concat('v', CAST(page_id % 3 AS STRING)) AS vault_id, SHA(html) AS hash, SHA(unhex(substr(hex(encode(html)), 81))) AS rest_hash,
  SHA(unhex(substr(hex(encode(html)), 81, 5000000))) AS part_hash FROM pages""",
)
def _ranges(pages):
    """From byte 40 to the end, and the 2.5 million bytes asked for, of every stored page."""
    store = pages.select(F.concat(F.lit("v"), F.col("page_id") % 3).alias("vault_id"), F.sha2("html", 256).alias("hash"),
                         F.encode("html", "UTF-8").alias("content"), F.octet_length("html").cast("long").alias("size"))
    rest = B.verify_blob_bytes(store, store, 40).select("vault_id", "hash", F.sha2("bytes", 256).alias("rest_hash"))
    part = B.verify_blob_bytes(store, store, 40, 2_500_000).select("vault_id", "hash", F.sha2("bytes", 256).alias("part_hash"))
    return rest.join(part, ["vault_id", "hash"])


@AREA.add(
    "s11_ingest_blobs", "documents", "inventory",
    steps={
        "up": """SELECT concat('v', CAST(doc_id % 3 AS STRING)) AS vault_id, SHA(text) AS hash, CAST(BLEN(text) AS BIGINT) AS size, doc_id AS at_ms, doc_id % 10 = 4 AS bad FROM documents""",
    },
    sql="""SELECT 'new' AS part, u.vault_id, u.hash, min(u.size) AS size, min(u.at_ms) AS at_ms FROM up u ANTI JOIN inventory i ON u.vault_id = i.vault_id AND u.hash = i.hash
WHERE NOT u.bad GROUP BY u.vault_id, u.hash
UNION ALL SELECT 'blob_integrity_mismatch', vault_id, hash, size, at_ms FROM up WHERE bad""",
)
def _ingest(documents, inventory):
    """Every document uploaded as a blob; one in ten declares a wrong hash."""
    digest = F.sha2("text", 256)
    uploads = documents.select(
        F.concat(F.lit("v"), F.col("doc_id") % 3).alias("vault_id"), F.encode("text", "UTF-8").alias("content"), F.col("doc_id").alias("at_ms"),
        F.when(F.col("doc_id") % 10 == 4, F.reverse(digest)).otherwise(digest).alias("declared_hash"),
        F.octet_length("text").cast("long").alias("declared_size"),
    )
    fresh, rejected = B.ingest_blobs(uploads, inventory)
    columns = ["vault_id", "hash", "size"]
    return fresh.select(F.lit("new").alias("part"), *columns, F.col("first_ref_at").alias("at_ms")).unionByName(
        rejected.select(F.col("reason").alias("part"), *columns, "at_ms")
    )
