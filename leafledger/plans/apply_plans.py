"""Registered queries: conditional apply, idempotency, policy."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..operators.apply import apply_ops, assign_seq, dedupe_ops, feed_rows, written_rows
from ..operators.blobs import check_blob_puts
from ..operators.policy import authorize_ops, explain_failures
from .bridge import EPOCH, VIEWS
from .catalog import Area

AREA = Area()

# The fold written once in SQL: one recursion step per operation of a path.
FOLD_STEPS = {
    "numbered": "SELECT *, row_number() OVER (PARTITION BY vault_id, path ORDER BY arrival) AS n FROM ops",
    "replayed": """/*RECURSIVE_STEP*/
SELECT vault_id, path, n, arrival, expected_rev = 0 AS accepted,
  CASE WHEN expected_rev = 0 THEN CAST(1 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS rev,
  CASE WHEN expected_rev = 0 THEN false ELSE true END AS gone, CAST(0 AS BIGINT) AS prior_rev, true AS prior_gone, op
FROM numbered WHERE n = 1
UNION ALL
SELECT o.vault_id, o.path, o.n, o.arrival,
  CASE WHEN o.expected_rev = 0 THEN f.gone ELSE f.rev = o.expected_rev END AS accepted,
  f.rev + CASE WHEN (CASE WHEN o.expected_rev = 0 THEN f.gone ELSE f.rev = o.expected_rev END) THEN 1 ELSE 0 END AS rev,
  CASE WHEN (CASE WHEN o.expected_rev = 0 THEN f.gone ELSE f.rev = o.expected_rev END) THEN o.op = 'delete' ELSE f.gone END AS gone,
  f.rev AS prior_rev, f.gone AS prior_gone, o.op
FROM replayed f JOIN numbered o ON o.vault_id = f.vault_id AND o.path = f.path AND o.n = f.n + 1""",
}


@AREA.add(
    "t1_apply_ops", "ops", steps=FOLD_STEPS,
    sql="""
SELECT vault_id, arrival, accepted, CASE WHEN NOT accepted THEN 'precondition_failed' END AS reason,
  CASE WHEN accepted THEN CASE WHEN prior_gone THEN 201 ELSE 200 END END AS status,
  CASE WHEN accepted THEN rev END AS rev, CASE WHEN accepted THEN gone END AS deleted,
  CASE WHEN NOT accepted AND prior_rev > 0 THEN prior_rev END AS current_rev,
  CASE WHEN NOT accepted AND prior_rev > 0 THEN prior_gone END AS current_deleted
FROM replayed""",
)
def _apply(ops):
    out = apply_ops(ops.drop("op_key", "payload"))
    return out.select("vault_id", "arrival", "accepted", "reason", "status", "rev", "deleted", "current_rev", "current_deleted")


@AREA.add(
    "t1_live_limit", "ops",
    sql="""
SELECT vault_id, arrival, n <= 200 AS accepted, CASE WHEN n > 200 THEN 'capacity_exceeded' END AS reason
FROM (SELECT vault_id, arrival, row_number() OVER (PARTITION BY vault_id ORDER BY arrival) AS n FROM ops) t""",
)
def _live_limit(ops):
    """Every operation creates a path of its own; the 201st of a vault is over the limit."""
    log = ops.select("vault_id", "arrival", F.lit("put").alias("op"), F.concat(F.lit("New/"), "arrival", F.lit(".md")).alias("path"),
                     F.lit("absent").alias("expect"), "payload_hash")
    return apply_ops(log, live_limit=200).select("vault_id", "arrival", "accepted", "reason")


@AREA.add(
    "t1_operation_rules", "ops",
    sql="""
SELECT vault_id, arrival, CASE
    WHEN op = 'put' AND expect = 'absent' AND NOT moved THEN NULL
    WHEN op IN ('put', 'delete', 'append', 'restore') AND expect = 'match' AND has_rev AND NOT moved THEN 'precondition_failed'
    WHEN op = 'rename' AND expect = 'match' AND has_rev AND moved THEN 'precondition_failed'
    WHEN op = 'append' AND coalesce(expect, 'none') = 'none' AND NOT moved THEN 'not_found'
    ELSE 'invalid_request' END AS reason
FROM (
  SELECT vault_id, arrival, CASE arrival % 6 WHEN 0 THEN 'put' WHEN 1 THEN 'delete' WHEN 2 THEN 'rename' WHEN 3 THEN 'append'
      WHEN 4 THEN 'restore' ELSE 'read' END AS op,
    CASE (arrival // 6) % 4 WHEN 0 THEN 'match' WHEN 1 THEN 'absent' WHEN 2 THEN 'none' END AS expect,
    (arrival // 24) % 2 = 0 AS has_rev, (arrival // 48) % 2 = 0 AS moved FROM ops) t""",
)
def _operation_rules(ops):
    """Every kind of operation with every precondition, with and without a revision and a second path, on paths that never were."""
    a = F.col("arrival")
    pick = lambda names, n: F.element_at(F.array(*[F.lit(x) for x in names]), (n + 1).cast("int"))
    log = ops.select(
        "vault_id", "arrival", pick(["put", "delete", "rename", "append", "restore", "read"], a % 6).alias("op"),
        F.concat(F.lit("Rule/"), "arrival", F.lit(".md")).alias("path"),
        F.when(F.floor(a / 48) % 2 == 0, F.concat(F.lit("Rule/to-"), "arrival", F.lit(".md"))).alias("to_path"),
        pick(["match", "absent", "none", None], F.floor(a / 6) % 4).alias("expect"),
        F.when(F.floor(a / 24) % 2 == 0, F.lit(3).cast("long")).alias("expected_rev"), "payload_hash", F.lit("x").alias("content"),
    )
    # Without an explicit precondition, a revision stands for ``match``.
    log = log.withColumn("expected_rev", F.when(F.col("expect").isNotNull(), F.col("expected_rev")))
    return apply_ops(log).select("vault_id", "arrival", "reason")


@AREA.add(
    "w3_assign_seq", "ops", steps=FOLD_STEPS,
    sql="""
SELECT r.vault_id, CAST(row_number() OVER (PARTITION BY r.vault_id ORDER BY r.arrival) AS BIGINT) AS seq,
  r.op, r.path, r.rev, CASE WHEN r.gone THEN '' ELSE n.payload_hash END AS hash, n.client_id AS origin, n.at_ms
FROM replayed r JOIN numbered n ON r.vault_id = n.vault_id AND r.arrival = n.arrival WHERE r.accepted""",
)
def _sequence(ops):
    log = ops.drop("op_key", "payload")
    return feed_rows(assign_seq(apply_ops(log)), log).drop("from_path", "from_rev")


@AREA.add(
    "t6_revisions_of_log", "ops", steps=FOLD_STEPS,
    sql="""
SELECT r.vault_id, r.path, r.rev, CASE WHEN r.gone THEN '' ELSE n.payload_hash END AS hash, r.gone AS deleted,
  CASE WHEN NOT r.gone THEN n.payload END AS content, n.client_id AS origin, n.at_ms
FROM replayed r JOIN numbered n ON r.vault_id = n.vault_id AND r.arrival = n.arrival WHERE r.accepted""",
)
def _revisions(ops):
    log = ops.drop("op_key").withColumnRenamed("payload", "content")
    out = written_rows(apply_ops(log).filter("accepted"), log)
    return out.select("vault_id", "path", "rev", "hash", "deleted", "content", "origin", "at_ms")


# Chains of one kind of operation, every seventh one stale, with a closed form in SQL.
_CHAIN = """
SELECT vault_id, who, arrival, stale, payload, payload_hash, at_ms,
  CAST(sum(CASE WHEN stale THEN 0 ELSE 1 END) OVER w AS BIGINT) - CASE WHEN stale THEN 0 ELSE 1 END AS k
FROM (
  SELECT concat('v', CAST(user_id % 3 AS STRING)) AS vault_id, user_id AS who, event_id + 1 AS arrival,
    event_id % 7 = 0 AS stale, props AS payload, SHA(props) AS payload_hash, MS(ts) AS at_ms
  FROM events) t
WINDOW w AS (PARTITION BY who ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
VIEWS["chain"] = _CHAIN


@AREA.add(
    "t4_apply_renames", "chain",
    sql="""
SELECT vault_id, arrival, NOT stale AS accepted, CASE WHEN NOT stale THEN 201 END AS status,
  CASE WHEN stale THEN NULL WHEN k % 2 = 0 THEN k + 1 ELSE k END AS rev,
  CASE WHEN stale OR k = 0 THEN NULL WHEN k % 2 = 1 THEN k + 1 ELSE k END AS from_rev,
  CASE WHEN stale THEN 'precondition_failed' END AS reason,
  CASE WHEN NOT stale THEN first_value(CASE WHEN NOT stale THEN payload_hash END IGNORE NULLS)
    OVER (PARTITION BY who ORDER BY arrival) END AS hash
FROM chain""",
)
def _renames(chain):
    """One file per user moves to and fro between two paths; tombstones keep counting."""
    here = F.concat(F.lit("Move/u"), "who", F.when(F.col("k") % 2 == 1, F.lit("/a.md")).otherwise("/b.md"))
    there = F.concat(F.lit("Move/u"), "who", F.when(F.col("k") % 2 == 1, F.lit("/b.md")).otherwise("/a.md"))
    first = F.col("k") == 0
    source_rev = F.when(F.col("k") % 2 == 1, F.col("k")).otherwise(F.col("k") - 1)
    ops = chain.select(
        "vault_id", "arrival", F.when(first, "put").otherwise("rename").alias("op"),
        F.when(first, there).otherwise(here).alias("path"), F.when(~first, there).alias("to_path"),
        F.when(first & ~F.col("stale"), "absent").otherwise("match").alias("expect"),
        (source_rev + F.when(F.col("stale"), 5).otherwise(0)).alias("expected_rev"),
        "payload_hash", F.octet_length("payload").cast("long").alias("size"), "at_ms",
    )
    return apply_ops(ops).select("vault_id", "arrival", "accepted", "status", "rev", "from_rev", "reason", "hash")


@AREA.add(
    "t3_apply_appends", "chain",
    sql="""
SELECT vault_id, arrival, rev, status, SHA(string_agg(payload, '') OVER w) AS hash,
  CAST(BLEN(string_agg(payload, '') OVER w) AS BIGINT) AS size, string_agg(payload, '') OVER w AS content
FROM (
  SELECT *, row_number() OVER (PARTITION BY who ORDER BY arrival) AS rev,
    CASE WHEN row_number() OVER (PARTITION BY who ORDER BY arrival) = 1 THEN 201 ELSE 200 END AS status FROM chain
) t
WINDOW w AS (PARTITION BY who ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
def _appends(chain):
    """The first event of a user creates a note, all others append to it."""
    start = chain.groupBy("who").agg(F.min("arrival").alias("start"))
    ops = chain.join(start, "who").select(
        "vault_id", "arrival", F.when(F.col("arrival") == F.col("start"), "put").otherwise("append").alias("op"),
        F.concat(F.lit("Log/u"), "who", F.lit(".md")).alias("path"),
        F.when(F.col("arrival") == F.col("start"), "absent").otherwise("none").alias("expect"),
        "payload_hash", F.octet_length("payload").cast("long").alias("size"), F.col("payload").alias("content"), "at_ms",
    )
    accepted = apply_ops(ops).filter("accepted")
    return written_rows(accepted, ops).join(accepted.select("vault_id", "arrival", "status"), ["vault_id", "arrival"]).select(
        "vault_id", "arrival", "rev", "status", "hash", "size", "content"
    )


@AREA.add(
    "t5_apply_restores", "chain",
    sql="""
SELECT vault_id, arrival, NOT stale AS accepted, CASE WHEN stale THEN 'precondition_failed' END AS reason,
  CASE WHEN NOT stale THEN k + 1 END AS rev, CASE WHEN NOT stale THEN k % 3 = 1 END AS deleted,
  CASE WHEN stale THEN NULL WHEN k % 3 = 1 THEN '' WHEN k % 3 = 0 THEN payload_hash
    ELSE first_value(CASE WHEN NOT stale THEN payload_hash END IGNORE NULLS) OVER (PARTITION BY who ORDER BY arrival) END AS hash
FROM chain""",
)
def _restores(chain):
    """Create or update, delete, restore revision 1, and again."""
    step = F.col("k") % 3
    ops = chain.select(
        "vault_id", "arrival",
        F.when(step == 0, "put").when(step == 1, "delete").otherwise("restore").alias("op"),
        F.concat(F.lit("Redo/u"), "who", F.lit(".md")).alias("path"),
        F.when((F.col("k") == 0) & ~F.col("stale"), "absent").otherwise("match").alias("expect"),
        (F.col("k") + F.when(F.col("stale"), 5).otherwise(0)).alias("expected_rev"), F.lit(1).cast("long").alias("source_rev"),
        "payload_hash", F.octet_length("payload").cast("long").alias("size"), F.col("payload").alias("content"), "at_ms",
    )
    return apply_ops(ops).select("vault_id", "arrival", "accepted", "reason", "rev", "deleted", "hash")


@AREA.add(
    "t2_dedupe_ops", "ops",
    sql="""
SELECT vault_id, arrival, first_arrival, CASE WHEN arrival = first_arrival THEN 'new' WHEN fingerprint = first_fp THEN 'replayed'
  ELSE 'idempotency_mismatch' END AS outcome
FROM (
  SELECT vault_id, arrival, SHA(concat(op, '|', payload_hash)) AS fingerprint,
    min(arrival) OVER (PARTITION BY vault_id, client_id, op_key) AS first_arrival,
    first_value(SHA(concat(op, '|', payload_hash))) OVER (PARTITION BY vault_id, client_id, op_key ORDER BY arrival) AS first_fp
  FROM ops) t""",
)
def _dedupe(ops):
    log = ops.withColumn("fingerprint", F.sha2(F.concat_ws("|", "op", "payload_hash"), 256))
    return dedupe_ops(log).select("vault_id", "arrival", "first_arrival", "outcome")


_KEYED = {
    "keyed": "SELECT *, SHA(concat(op, '|', path, '|', payload_hash)) AS fp FROM ops",
    "held": "SELECT DISTINCT vault_id, client_id, op_key FROM ops WHERE arrival % 13 = 0",
    "met": """SELECT o.*, r.arrival AS r_arrival, r.fingerprint AS r_fp, h.op_key IS NOT NULL AS claimed,
  min(o.arrival) OVER (PARTITION BY o.vault_id, o.client_id, o.op_key) AS first_arrival,
  first_value(o.fp) OVER (PARTITION BY o.vault_id, o.client_id, o.op_key ORDER BY o.arrival) AS first_fp
FROM keyed o LEFT JOIN (SELECT * FROM receipts WHERE arrival % 3 = 0) r ON o.vault_id = r.vault_id AND o.client_id = r.client_id AND o.op_key = r.op_key
LEFT JOIN held h ON o.vault_id = h.vault_id AND o.client_id = h.client_id AND o.op_key = h.op_key""",
}


@AREA.add(
    "t2_claims", "ops", "receipts", steps=_KEYED,
    sql="""SELECT vault_id, arrival, coalesce(r_arrival, first_arrival) AS first_arrival, CASE
    WHEN r_fp IS NOT NULL THEN CASE WHEN r_fp = fp THEN 'replayed' ELSE 'idempotency_mismatch' END
    WHEN claimed THEN 'idempotency_in_progress' WHEN arrival = first_arrival THEN 'new'
    WHEN first_fp = fp THEN 'replayed' ELSE 'idempotency_mismatch' END AS outcome FROM met""",
)
def _claims(ops, receipts):
    """Keys with a stored receipt, keys that another request holds, and free ones."""
    log = ops.withColumn("fingerprint", F.sha2(F.concat_ws("|", "op", "path", "payload_hash"), 256))
    held = ops.filter("arrival % 13 = 0").select("vault_id", "client_id", "op_key")
    return dedupe_ops(log, receipts.filter("arrival % 3 = 0"), held).select("vault_id", "arrival", "first_arrival", "outcome")


@AREA.add(
    "t1_apply_full", "ops", "receipts",
    steps={
        "fresh": """SELECT o.* REPLACE (CASE WHEN (arrival - 1) % 11 <> 10 THEN op_key END AS op_key), SHA(concat(op, '|', path, '|', payload_hash)) AS fp
FROM ops o WHERE arrival > 2000""",
        "state": "SELECT vault_id, path, rev, deleted FROM revisions WHERE arrival <= 2000 QUALIFY row_number() OVER (PARTITION BY vault_id, path ORDER BY rev DESC) = 1",
        "old": "SELECT vault_id, client_id, op_key, fingerprint, arrival FROM receipts WHERE arrival <= 2000",
        "held": "SELECT DISTINCT vault_id, client_id, op_key FROM ops WHERE arrival % 1300 = 0",
        "judged": """SELECT f.*, CASE WHEN f.arrival % 17 = 0 THEN 'forbidden_scope' WHEN o.fingerprint = f.fp THEN 'replayed'
    WHEN o.fingerprint IS NOT NULL THEN 'idempotency_mismatch' WHEN h.op_key IS NOT NULL THEN 'idempotency_in_progress' END AS early
FROM fresh f LEFT JOIN old o ON f.vault_id = o.vault_id AND f.client_id = o.client_id AND f.op_key = o.op_key
LEFT JOIN held h ON f.vault_id = h.vault_id AND f.client_id = h.client_id AND f.op_key = h.op_key""",
        "left_": "SELECT vault_id, path, arrival, op, expected_rev, row_number() OVER (PARTITION BY vault_id, path ORDER BY arrival) AS n FROM judged WHERE early IS NULL",
        "replayed": """/*RECURSIVE_STEP*/
SELECT l.vault_id, l.path, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS arrival, false AS accepted, coalesce(s.rev, 0) AS rev, coalesce(s.deleted, true) AS gone
FROM (SELECT DISTINCT vault_id, path FROM left_) l LEFT JOIN state s ON l.vault_id = s.vault_id AND l.path = s.path
UNION ALL
SELECT l.vault_id, l.path, l.n, l.arrival, CASE WHEN l.expected_rev = 0 THEN f.gone ELSE f.rev = l.expected_rev END,
  f.rev + CASE WHEN (CASE WHEN l.expected_rev = 0 THEN f.gone ELSE f.rev = l.expected_rev END) THEN 1 ELSE 0 END,
  CASE WHEN (CASE WHEN l.expected_rev = 0 THEN f.gone ELSE f.rev = l.expected_rev END) THEN l.op = 'delete' ELSE f.gone END
FROM replayed f JOIN left_ l ON l.vault_id = f.vault_id AND l.path = f.path AND l.n = f.n + 1""",
    },
    sql="""SELECT j.vault_id, j.arrival, coalesce(r.accepted, false) AS accepted, coalesce(j.early, CASE WHEN NOT r.accepted THEN 'precondition_failed' END) AS reason,
  CASE WHEN r.accepted THEN r.rev END AS rev
FROM judged j LEFT JOIN replayed r ON j.vault_id = r.vault_id AND j.arrival = r.arrival AND r.n > 0""",
)
def _apply_full(ops, receipts):
    """The later part of the log over the state of the earlier one: stored files, receipts, claims and policy, then the fold."""
    fingerprint = F.sha2(F.concat_ws("|", "op", "path", "payload_hash"), 256)
    log = ops.filter("arrival > 2000").drop("payload").withColumns({"fingerprint": fingerprint, "reason": F.when(F.col("arrival") % 17 == 0, "forbidden_scope")})
    # Every eleventh key repeats the one before it; without those, no operation depends on another's receipt.
    log = log.withColumn("op_key", F.when((F.col("arrival") - 1) % 11 != 10, F.col("op_key")))
    early = ops.filter("arrival <= 2000").drop("op_key", "payload")
    written = written_rows(apply_ops(early).filter("accepted"), early)
    state = written.groupBy("vault_id", "path").agg(F.max_by(F.struct("rev", "hash", "size", "kind", "content", "renamed_to", "deleted"), "rev").alias("s")).select("vault_id", "path", "s.*")
    held = ops.filter("arrival % 1300 = 0").select("vault_id", "client_id", "op_key")
    out = apply_ops(log, state, receipts.filter("arrival <= 2000"), claims=held)
    return out.select("vault_id", "arrival", "accepted", "reason", "rev")


@AREA.add(
    "j15_receipt_lookup", "ops", "receipts",
    sql="""
SELECT o.vault_id, o.arrival, r.arrival AS first_arrival,
  CASE WHEN r.fingerprint IS NULL THEN 'new' WHEN r.fingerprint = SHA(concat(o.op, '|', o.path, '|', o.payload_hash)) THEN 'replayed'
    ELSE 'idempotency_mismatch' END AS outcome
FROM ops o LEFT JOIN receipts r ON o.vault_id = r.vault_id AND o.client_id = r.client_id AND o.op_key = r.op_key""",
)
def _receipts(ops, receipts):
    stored = receipts.select("vault_id", "client_id", "op_key", F.col("arrival").alias("first_arrival"), F.col("fingerprint").alias("_fp"))
    mine = F.sha2(F.concat_ws("|", "op", "path", "payload_hash"), 256)
    return ops.join(stored, ["vault_id", "client_id", "op_key"], "left").select(
        "vault_id", "arrival", "first_arrival",
        F.when(F.col("_fp").isNull(), "new").when(F.col("_fp") == mine, "replayed").otherwise("idempotency_mismatch").alias("outcome"),
    )


_POLICY = """
SELECT q.vault_id, q.arrival, CASE WHEN r.grant_id IS NOT NULL THEN 'revoked'
  WHEN (q.op = 'delete' AND NOT can_delete) OR (q.op IN ('put','append') AND NOT can_write) THEN 'forbidden_scope'
  WHEN coalesce(q.epoch, q.match_epoch) <> '0123456789abcdef0123456789abcdef' THEN 'epoch_mismatch' END AS reason
FROM requests q LEFT JOIN revoked r ON q.grant_id = r.grant_id"""


def _with_scopes(requests):
    return requests.withColumn(
        "scopes",
        F.array_compact(F.array(F.lit("vault:read"), F.when(F.col("can_write"), "vault:write"), F.when(F.col("can_delete"), "vault:delete"))),
    )


def _vault_state(requests):
    return requests.select("vault_id").distinct().withColumn("epoch", F.lit(EPOCH))


@AREA.add("p17_authorize_ops", "requests", "revoked", sql=_POLICY)
def _authorize(requests, revoked):
    return authorize_ops(_with_scopes(requests), _vault_state(requests), revoked).select("vault_id", "arrival", "reason")


@AREA.add(
    "p21_explain_failures", "requests", "revoked", steps={"judged": _POLICY},
    sql="""
SELECT j.vault_id, j.arrival, j.reason, CASE j.reason WHEN 'revoked' THEN 401 WHEN 'forbidden_scope' THEN 403 ELSE 409 END AS status,
  CASE j.reason WHEN 'revoked' THEN 'The grant no longer allows access.'
    WHEN 'forbidden_scope' THEN 'The grant does not allow this operation.' ELSE 'The vault epoch does not match.' END AS message
FROM judged j WHERE reason IS NOT NULL""",
)
def _explain(requests, revoked):
    judged = authorize_ops(_with_scopes(requests), _vault_state(requests), revoked).filter(F.col("reason").isNotNull())
    empty = {f"current_{c}": F.lit(None).cast(t) for c, t in
             (("rev", "long"), ("hash", "string"), ("deleted", "boolean"), ("renamed_to", "string"), ("content", "string"))}
    return explain_failures(judged.withColumns(empty)).select("vault_id", "arrival", "reason", "status", "message")


_CODES = ", ".join(f"({i}, '{c}', {status}, '{message}')" for i, (c, status, message) in enumerate(K.FAILURES))


@AREA.add(
    "p21_every_code", "ops", steps={"codes": f"SELECT * FROM (VALUES {_CODES}) t(n, reason, status, message)"},
    sql=f"""SELECT o.vault_id, o.arrival, c.reason, CAST(c.status AS INT) AS status, c.message,
  CASE WHEN c.reason = 'precondition_failed' THEN o.payload_hash END AS detail_hash
FROM ops o JOIN codes c ON o.arrival % {len(K.FAILURES) + 1} = c.n""",
)
def _every_code(ops):
    """Each operation refused with the next code of the closed list; one in a round has a code outside of it, which is left without status."""
    names = F.array(*[F.lit(c) for c, _, _ in K.FAILURES], F.lit("no_such_code"))
    rejected = ops.withColumns(
        {
            "reason": F.element_at(names, (F.col("arrival") % (len(K.FAILURES) + 1) + 1).cast("int")), "scopes": F.array(F.lit("vault:read")),
            "current_epoch": F.lit(EPOCH), "current_rev": F.lit(1).cast("long"), "current_hash": F.col("payload_hash"), "current_deleted": F.lit(False),
            "current_renamed_to": F.lit(None).cast("string"), "current_content": F.lit(None).cast("string"),
        }
    )
    explained = explain_failures(rejected).filter("status IS NOT NULL")
    return explained.select("vault_id", "arrival", "reason", "status", "message", "detail_hash")


@AREA.add(
    "p22_redact_details", "requests", "notes",
    sql="""
SELECT q.vault_id, q.arrival, 412 AS status, concat('"0123456789abcdef0123456789abcdef.', CAST(n.rev AS STRING), '"') AS detail_etag,
  n.hash AS detail_hash, n.deleted AS detail_deleted, CASE WHEN n.deleted THEN n.renamed_to END AS detail_renamed_to,
  CASE WHEN q.can_write AND NOT n.deleted THEN n.content END AS detail_content
FROM requests q JOIN notes n ON q.vault_id = n.vault_id AND q.arrival = n.seq""",
)
def _redact(requests, notes):
    scopes = F.when(F.col("can_write"), F.array(F.lit("vault:read"))).otherwise(F.array(F.lit("vault:write")))
    current = notes.select("vault_id", F.col("seq").alias("arrival"),
                           *[F.col(c).alias(f"current_{c}") for c in ("rev", "hash", "deleted", "renamed_to", "content")])
    rejected = requests.withColumn("scopes", scopes).join(current, ["vault_id", "arrival"]).withColumns(
        {"reason": F.lit("precondition_failed"), "current_epoch": F.lit(EPOCH)}
    )
    return explain_failures(rejected).select(
        "vault_id", "arrival", "status", "detail_etag", "detail_hash", "detail_deleted", "detail_renamed_to", "detail_content"
    )


@AREA.add(
    "t7_blob_puts", "revisions", "inventory", "pins",
    steps={
        "marked": "SELECT DISTINCT i.vault_id, i.hash FROM inventory i JOIN revisions r ON i.vault_id = r.vault_id AND i.hash = r.blob_hash "
                  "JOIN pins p ON p.vault_id = r.vault_id AND p.path = r.path AND p.rev = r.rev",
    },
    sql="""
SELECT r.vault_id, r.path, r.rev, CASE WHEN i.size <> r.size THEN 'blob_integrity_mismatch'
  WHEN m.hash IS NOT NULL THEN 'blob_gc_in_progress' END AS reason
FROM revisions r LEFT JOIN inventory i ON r.vault_id = i.vault_id AND r.blob_hash = i.hash
LEFT JOIN marked m ON r.vault_id = m.vault_id AND r.blob_hash = m.hash WHERE r.kind = 'blob'""",
)
def _blob_puts(revisions, inventory, pins):
    marks = revisions.join(pins.select("vault_id", "path", "rev"), ["vault_id", "path", "rev"]).select(
        "vault_id", F.col("blob_hash").alias("hash")
    ).filter("hash is not null").join(inventory.select("vault_id", "hash"), ["vault_id", "hash"]).distinct()
    puts = revisions.filter("kind = 'blob'").withColumn("payload_hash", F.col("blob_hash"))
    return check_blob_puts(puts, inventory, marks).select("vault_id", "path", "rev", "reason")
