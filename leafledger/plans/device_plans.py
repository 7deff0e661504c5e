"""Registered queries: device replay, apply plans, reconciliation, outgoing queue."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import device as D
from ..streaming.jobs import debounce_events
from .bridge import EPOCH, VIEWS
from .catalog import Area

AREA = Area()

_NOW = 1706400000000
_NAME = "Desk Pad"


def _copy_sql(path: str, rev: str, at: str) -> str:
    """Conflict name of an ordinary (non-settings) path."""
    return rf"""regexp_replace({path}, '\.([^./]*)$', concat(' (conflict Desk Pad ', strftime(epoch_ms({at}), '%Y-%m-%d %H%M'), ' r', CAST({rev} AS STRING), ').\1'))"""


_JOINED = {
    "seen": """SELECT f.*, l.hash AS lh, coalesce(l.size, 0) AS ls, b.rev AS br, b.hash AS bh, b.deleted AS bd, b.stale AS bs
FROM feed f LEFT JOIN local l ON f.vault_id = l.vault_id AND f.path = l.path LEFT JOIN base b ON f.vault_id = b.vault_id AND f.path = b.path WHERE op <> 'rename'""",
    "planned": """SELECT *, CASE WHEN br IS NOT NULL AND rev <= br AND NOT bs THEN 'ignore' WHEN ls > 25000000 THEN 'attention'
  WHEN op = 'put' AND lh = hash THEN 'none' WHEN op = 'put' AND lh IS NULL THEN 'create'
  WHEN op = 'put' THEN CASE WHEN NOT bd AND lh = bh THEN 'replace' ELSE 'copy_then_replace' END
  WHEN lh IS NULL THEN 'none' WHEN NOT bd AND lh = bh THEN 'trash' ELSE 'copy_then_trash' END AS action FROM seen""",
}


@AREA.add(
    "t9_plan_apply", "feed", "local", "base", steps=_JOINED,
    sql=f"""SELECT device_id, vault_id, path, seq, op, rev, action, CASE WHEN action LIKE 'copy%' THEN {_copy_sql('path', 'rev', 'at_ms')} END AS copy_path,
  CASE WHEN action IN ('ignore','attention') THEN br ELSE rev END AS new_rev,
  CASE WHEN action IN ('ignore','attention') THEN bh WHEN op = 'put' THEN hash END AS new_hash,
  CASE WHEN action IN ('ignore','attention') THEN bd ELSE op = 'delete' END AS new_deleted FROM planned""",
)
def _plan(feed, local, base):
    out = D.plan_apply(feed.filter("op <> 'rename'"), local, base, _NAME)
    return out.select("device_id", "vault_id", "path", "seq", "op", "rev", "action", "copy_path", "new_rev", "new_hash", "new_deleted")


@AREA.add(
    "w10_rank_copies", "feed", "local", "base",
    steps=_JOINED | {"again": "SELECT *, seq AS s2 FROM planned UNION ALL SELECT *, seq + 100000 FROM planned"},
    sql=f"SELECT device_id, vault_id, path, rev, min(s2) AS seq, {_copy_sql('path', 'rev', 'min(at_ms)')} AS copy_path FROM again WHERE action LIKE 'copy%' GROUP BY device_id, vault_id, path, rev",
)
def _rank(feed, local, base):
    plans = D.plan_apply(feed.filter("op <> 'rename'"), local, base, _NAME)
    return D.rank_copies(plans.unionByName(plans.withColumn("seq", F.col("seq") + 100_000)))


@AREA.add(
    "t10_plan_rename", "feed", "local", "base",
    steps={
        "moves": "SELECT device_id, vault_id, path AS from_path, seq, replace(path, 'Doc-', CASE WHEN seq % 2 = 0 THEN 'Doc-' ELSE 'New-' END) AS path, rev, hash, rev + 1 AS from_rev, at_ms FROM feed WHERE op = 'put'",
        "sides": """SELECT m.*, s.hash AS lsh, bs.rev AS bsr, bs.hash AS bsh, bs.deleted AS bsd, bs.stale AS bss, d.hash AS ldh, bd.rev AS bdr, bd.hash AS bdh, bd.deleted AS bdd, bd.stale AS bds
FROM moves m LEFT JOIN local s ON m.vault_id = s.vault_id AND m.from_path = s.path LEFT JOIN base bs ON m.vault_id = bs.vault_id AND m.from_path = bs.path
LEFT JOIN local d ON m.vault_id = d.vault_id AND m.path = d.path LEFT JOIN base bd ON m.vault_id = bd.vault_id AND m.path = bd.path""",
        "flags": """SELECT *, bsr IS NOT NULL AND (bsr < from_rev OR bss) AS sp, bdr IS NULL OR bdr < rev OR bds AS tp,
  coalesce(NOT bsd AND lsh = bsh, false) AS sc, coalesce(NOT bdd AND ldh = bdh, false) AS tc FROM sides""",
        "acts": "SELECT *, CASE WHEN NOT sp AND NOT tp THEN 'noop' WHEN sp AND tp AND sc AND ldh IS NULL THEN 'local_rename' ELSE 'two_sides' END AS action FROM flags",
    },
    sql="""SELECT device_id, vault_id, seq, from_path, path, sp AS source_pending, tp AS target_pending, action,
  CASE WHEN action = 'two_sides' THEN CASE WHEN NOT sp THEN 'skip' WHEN lsh IS NULL THEN 'none' WHEN sc THEN 'trash' ELSE 'copy_then_trash' END END AS source_action,
  CASE WHEN action = 'two_sides' THEN CASE WHEN NOT tp THEN 'skip' WHEN ldh = hash THEN 'none' WHEN ldh IS NULL THEN 'create' WHEN tc THEN 'replace' ELSE 'copy_then_replace' END END AS target_action
FROM acts""",
)
def _plan_rename(feed, local, base):
    word = F.when(F.col("seq") % 2 == 0, "Doc-").otherwise("New-")
    moves = feed.filter("op = 'put'").withColumns(
        {"from_path": F.col("path"), "from_rev": F.col("rev") + 1, "path": F.replace(F.col("path"), F.lit("Doc-"), word)}
    )
    out = D.plan_rename(moves, local, base, _NAME)
    return out.select("device_id", "vault_id", "seq", "from_path", "path", "source_pending", "target_pending", "action", "source_action", "target_action")


@AREA.add(
    "t8_replay_feed", "feed", "base",
    sql="""SELECT f.device_id, f.vault_id, f.seq, f.op, f.path, f.rev FROM feed f LEFT JOIN base b ON f.vault_id = b.vault_id AND f.path = b.path
WHERE f.op = 'rename' OR b.rev IS NULL OR f.rev > b.rev OR b.stale""",
)
def _replay(feed, base):
    return D.replay_feed(feed, base).select("device_id", "vault_id", "seq", "op", "path", "rev")


@AREA.add(
    "j12_fence_feed", "feed", "device_ops",
    steps={
        "sent": """SELECT vault_id, lower(path) AS k FROM device_ops WHERE state = 'sent'
UNION SELECT vault_id, lower(to_path) FROM device_ops WHERE state = 'sent' AND op = 'rename'""",
        "stop": """SELECT f.vault_id, min(f.seq) AS s FROM feed f JOIN sent x ON f.vault_id = x.vault_id AND (lower(f.path) = x.k OR (f.op = 'rename' AND lower(f.from_path) = x.k)) GROUP BY f.vault_id""",
    },
    sql="SELECT f.device_id, f.vault_id, f.seq, f.op, f.path FROM feed f LEFT JOIN stop s ON f.vault_id = s.vault_id WHERE s.s IS NULL OR f.seq < s.s",
)
def _fence(feed, device_ops):
    return D.fence_feed(feed, device_ops).select("device_id", "vault_id", "seq", "op", "path")


@AREA.add(
    "j14_classify_deletes", "feed", "notes",
    steps={"gone": "SELECT device_id, vault_id, path, rev + CASE WHEN seq % 3 = 0 THEN 0 ELSE -1 END AS rev, seq - CASE WHEN seq % 3 = 1 THEN 1 ELSE 0 END AS seq FROM feed WHERE op = 'delete'"},
    sql="""SELECT g.device_id, g.vault_id, g.path, g.rev, g.seq, CASE WHEN n.rev > g.rev AND n.seq > g.seq THEN 'superseded'
  WHEN n.rev = g.rev AND n.seq = g.seq AND n.deleted THEN n.kind ELSE 'unconfirmed' END AS verdict
FROM gone g LEFT JOIN notes n ON g.vault_id = n.vault_id AND g.path = n.path""",
)
def _classify(feed, notes):
    third = F.col("seq") % 3
    gone = feed.filter("op = 'delete'").select(
        "device_id", "vault_id", "path", (F.col("rev") + F.when(third == 0, 0).otherwise(-1)).alias("rev"),
        (F.col("seq") - F.when(third == 1, 1).otherwise(0)).alias("seq"),
    )
    return D.classify_deletes(gone, notes)


_MANIFEST = {
    "m": """SELECT 'd1' AS device_id, n.vault_id, n.path, n.rev, n.hash, n.deleted, l.hash AS lh, coalesce(l.size, 0) AS ls, b.rev AS br, b.hash AS bh, b.deleted AS bd, b.stale AS bs
FROM notes n LEFT JOIN local l ON n.vault_id = l.vault_id AND n.path = l.path LEFT JOIN base b ON n.vault_id = b.vault_id AND n.path = b.path""",
    "laid": """SELECT *, CASE WHEN NOT deleted AND lh = hash AND ls <= 25000000 THEN 'none' WHEN br IS NOT NULL AND rev <= br AND NOT bs THEN 'ignore' WHEN ls > 25000000 THEN 'attention'
  WHEN NOT deleted AND lh IS NULL THEN 'create' WHEN NOT deleted THEN CASE WHEN NOT bd AND lh = bh THEN 'replace' ELSE 'copy_then_replace' END
  WHEN lh IS NULL THEN 'none' WHEN NOT bd AND lh = bh THEN 'trash' ELSE 'copy_then_trash' END AS action FROM m""",
}


@AREA.add(
    "j9_reconcile", "local", "base", "notes", steps=_MANIFEST,
    sql=f"""SELECT device_id, vault_id, path, rev, CASE WHEN NOT deleted AND lh = hash AND NOT (br IS NULL OR rev > br OR bs) THEN 'none' ELSE action END AS action,
  CASE WHEN action LIKE 'copy%' THEN {_copy_sql('path', 'rev', str(_NOW))} END AS copy_path FROM laid
UNION ALL SELECT l.device_id, l.vault_id, l.path, NULL, CASE WHEN l.size > 25000000 THEN 'attention' ELSE 'publish_create' END, NULL
FROM local l ANTI JOIN notes n ON l.vault_id = n.vault_id AND l.path = n.path""",
)
def _reconcile(local, base, notes):
    devices = local.select("device_id", "vault_id").distinct()
    return D.reconcile(devices, local, base, notes, _NAME, _NOW)


@AREA.add(
    "u3_u5_reconcile_sets", "local", "notes",
    sql="""SELECT coalesce(l.vault_id, n.vault_id) AS vault_id, coalesce(l.path, n.path) AS path,
  CASE WHEN n.path IS NULL THEN 'local_only' WHEN l.path IS NULL THEN 'remote_only' ELSE 'both' END AS side
FROM local l FULL OUTER JOIN notes n ON l.vault_id = n.vault_id AND l.path = n.path""",
)
def _sets(local, notes):
    return D.reconcile_sets(local, notes)


@AREA.add("u4_union_paths", "notes", "device_ops", sql="SELECT vault_id, path FROM notes UNION SELECT vault_id, path FROM device_ops WHERE state = 'resolved'")
def _union(notes, device_ops):
    return D.union_paths(notes, device_ops.filter("state = 'resolved'"))


@AREA.add(
    "j10_j19_detect_changes", "local", "base", "device_ops",
    steps={
        "queued": "SELECT DISTINCT vault_id, path, payload_hash FROM device_ops WHERE state <> 'resolved' AND op = 'put'",
        "targets": "SELECT DISTINCT vault_id, lower(to_path) AS k FROM device_ops WHERE state <> 'resolved' AND op = 'rename'",
    },
    sql="""SELECT l.device_id, l.vault_id, l.path, l.hash, l.size, CASE WHEN l.size > 25000000 THEN 'attention' ELSE 'put' END AS op,
  CASE WHEN l.size <= 25000000 THEN CASE WHEN b.rev IS NULL THEN 'absent' ELSE 'match' END END AS precondition, CASE WHEN l.size <= 25000000 THEN b.rev END AS expected_rev
FROM local l LEFT JOIN base b ON l.vault_id = b.vault_id AND l.path = b.path
LEFT JOIN queued q ON l.vault_id = q.vault_id AND l.path = q.path AND l.hash = q.payload_hash
LEFT JOIN targets t ON l.vault_id = t.vault_id AND lower(l.path) = t.k
WHERE t.k IS NULL AND (l.size > 25000000 OR (q.path IS NULL AND NOT coalesce(NOT b.deleted AND b.hash = l.hash, false)))""",
)
def _changes(local, base, device_ops):
    return D.detect_changes(local, base, device_ops)


@AREA.add(
    "j11_missing_to_restore", "local", "base", "device_ops",
    sql="""SELECT b.device_id, b.vault_id, b.path, b.rev, b.hash FROM base b WHERE NOT b.deleted
  AND NOT EXISTS (SELECT 1 FROM local l WHERE l.vault_id = b.vault_id AND lower(l.path) = lower(b.path))
  AND NOT EXISTS (SELECT 1 FROM device_ops o WHERE o.vault_id = b.vault_id AND lower(o.path) = lower(b.path) AND o.op IN ('delete','rename') AND o.state <> 'resolved')""",
)
def _missing(local, base, device_ops):
    return D.missing_to_restore(base, local, device_ops)


@AREA.add(
    "j13_ack_creates", "device_ops", "notes",
    sql="""SELECT o.device_id, o.vault_id, o.op_key, n.path, n.rev, n.hash FROM device_ops o JOIN notes n ON o.vault_id = n.vault_id AND lower(o.path) = lower(n.path) AND o.payload_hash = n.hash
WHERE o.state = 'sent' AND o.op = 'put' AND o.precondition = 'absent' AND NOT n.deleted""",
)
def _ack(device_ops, notes):
    return D.ack_creates(device_ops, notes)


# A busy queue: the events of each user on a few of its paths.
VIEWS["queue"] = """
SELECT concat('d', CAST(user_id % 2 AS STRING)) AS device_id, concat('v', CAST(user_id % 3 AS STRING)) AS vault_id, event_id AS arrival,
  concat('k', CAST(event_id AS STRING)) AS op_key, CASE event_type WHEN 'error' THEN 'delete' WHEN 'click' THEN 'rename' ELSE 'put' END AS op,
  concat(CASE WHEN event_id % 2 = 0 THEN 'N' ELSE 'n' END, '/u', CAST(user_id % 40 AS STRING), '.md') AS path,
  CASE WHEN event_type = 'click' THEN concat('n/u', CAST((user_id + 1) % 40 AS STRING), '.md') END AS to_path,
  CASE WHEN event_id % 5 = 0 THEN 'sent' WHEN event_id % 5 = 1 THEN 'resolved' ELSE 'queued' END AS state,
  CASE WHEN event_id % 3 = 0 THEN 'absent' ELSE 'match' END AS precondition, CASE WHEN event_id % 3 > 0 THEN event_id % 6 END AS expected_rev,
  SHA(props) AS payload_hash, CAST(NULL AS STRING) AS depends_on
FROM events"""


@AREA.add(
    "t11_coalesce_ops", "queue",
    steps={
        "open_": "SELECT * FROM queue WHERE state <> 'resolved'",
        "keyed": "SELECT DISTINCT * FROM (SELECT device_id, vault_id, arrival, op, lower(path) AS src, lower(path) AS k FROM open_ UNION ALL SELECT device_id, vault_id, arrival, op, lower(path), lower(to_path) FROM open_ WHERE op = 'rename') t",
        "led": """SELECT device_id, vault_id, arrival, lead(arrival) OVER w AS na, lead(op) OVER w AS nop, lead(src) OVER w AS nsrc FROM keyed WINDOW w AS (PARTITION BY device_id, vault_id, k ORDER BY arrival)""",
        "near": "SELECT device_id, vault_id, arrival, arg_min(nop, na) AS nop, arg_min(nsrc, na) AS nsrc FROM led WHERE na IS NOT NULL GROUP BY ALL",
    },
    sql="""SELECT o.device_id, o.vault_id, o.arrival, o.op, o.path, o.to_path, o.state FROM open_ o LEFT JOIN near n ON o.device_id = n.device_id AND o.vault_id = n.vault_id AND o.arrival = n.arrival
WHERE NOT (o.state = 'queued' AND coalesce(n.nop = o.op AND n.nsrc = lower(o.path), false))""",
)
def _coalesce(queue):
    return D.coalesce_ops(queue).select("device_id", "vault_id", "arrival", "op", "path", "to_path", "state")


@AREA.add(
    "t13_drop_echoes", "local_events",
    steps={
        "expected": "SELECT vault_id, path, max(hash) AS hash FROM local_events WHERE event = 'modify' GROUP BY vault_id, path",
        "first_": "SELECT e.vault_id, e.path, min(e.arrival) AS arrival FROM local_events e JOIN expected x ON e.vault_id = x.vault_id AND e.path = x.path AND e.hash = x.hash GROUP BY e.vault_id, e.path",
    },
    sql="SELECT e.vault_id, e.path, e.arrival, e.hash FROM local_events e ANTI JOIN first_ f ON e.vault_id = f.vault_id AND e.path = f.path AND e.arrival = f.arrival",
)
def _echoes(events):
    expected = events.filter("event = 'modify'").groupBy("device_id", "vault_id", "path").agg(F.max("hash").alias("hash"))
    return D.drop_echoes(events, expected).select("vault_id", "path", "arrival", "hash")


def _devices(df):
    return df.select("device_id", "vault_id").distinct().withColumns({"epoch": F.lit("old"), "cursor": F.lit(7).cast("long")})


def _epochs(df):
    return df.select("vault_id").distinct().withColumn("epoch", F.when(F.col("vault_id") == "v1", "old").otherwise("new"))


@AREA.add(
    "t17_reset_epoch", "base", "device_ops",
    sql="""SELECT 'base' AS part, vault_id, path AS id, CASE WHEN stale OR vault_id <> 'v1' THEN 1 ELSE 0 END AS value FROM base
UNION ALL SELECT 'queue', vault_id, op_key, 0 FROM device_ops WHERE vault_id = 'v1' UNION ALL SELECT 'attention', vault_id, op_key, 0 FROM device_ops WHERE vault_id <> 'v1'
UNION ALL SELECT DISTINCT 'device', vault_id, CASE WHEN vault_id = 'v1' THEN 'old' ELSE 'new' END, CASE WHEN vault_id = 'v1' THEN 7 END FROM base""",
)
def _reset(base, device_ops):
    after = D.reset_epoch(_devices(base), base, device_ops, _epochs(base))

    def part(name, key, id_column, value):
        return after[key].select(F.lit(name).alias("part"), "vault_id", F.col(id_column).alias("id"), value.cast("int").alias("value"))

    return (
        part("base", "base", "path", F.col("stale"))
        .unionByName(part("queue", "device_ops", "op_key", F.lit(0)))
        .unionByName(part("attention", "attention", "op_key", F.lit(0)))
        .unionByName(part("device", "devices", "epoch", F.col("cursor")))
    )


_RESOLVE = {
    "results": "SELECT device_id, op_key, coalesce(expected_rev, 0) + 1 AS rev, CASE WHEN op = 'delete' THEN NULL ELSE payload_hash END AS hash, op = 'delete' AS deleted FROM device_ops WHERE state = 'sent'",
    "done": """SELECT o.vault_id, CASE WHEN o.op = 'rename' THEN o.to_path ELSE o.path END AS path, r.rev, r.hash, r.deleted FROM device_ops o JOIN results r ON o.op_key = r.op_key AND o.device_id = r.device_id""",
}


@AREA.add(
    "t18_resolve_receipts_base", "base", "device_ops", steps=_RESOLVE,
    sql="""SELECT coalesce(b.vault_id, d.vault_id) AS vault_id, coalesce(b.path, d.path) AS path, CASE WHEN d.rev IS NOT NULL AND (b.rev IS NULL OR b.rev <= d.rev) THEN d.rev ELSE b.rev END AS rev,
  CASE WHEN d.rev IS NOT NULL AND (b.rev IS NULL OR b.rev <= d.rev) THEN d.hash ELSE b.hash END AS hash,
  CASE WHEN d.rev IS NOT NULL AND (b.rev IS NULL OR b.rev <= d.rev) THEN d.deleted ELSE b.deleted END AS deleted
FROM base b FULL OUTER JOIN done d ON b.vault_id = d.vault_id AND b.path = d.path""",
)
def _resolve_base(base, device_ops):
    return D.resolve_receipts(device_ops, _results(device_ops), base)["base"].select("vault_id", "path", "rev", "hash", "deleted")


def _results(device_ops):
    gone = F.col("op") == "delete"
    return device_ops.filter("state = 'sent'").select(
        "device_id", "op_key", (F.coalesce("expected_rev", F.lit(0)) + 1).alias("rev"), F.when(~gone, F.col("payload_hash")).alias("hash"), gone.alias("deleted")
    )


@AREA.add(
    "t18_resolve_receipts_queue", "base", "device_ops",
    steps=_RESOLVE | {
        "follow": """SELECT device_id, vault_id, concat('after-', op_key) AS op_key, arrival + 100000 AS arrival, path, CASE WHEN arrival % 2 = 0 THEN 'absent' ELSE 'match' END AS precondition,
  CASE WHEN arrival % 2 = 1 THEN arrival % 5 END AS expected_rev FROM device_ops WHERE state = 'sent' AND op <> 'rename'""",
    },
    sql="""SELECT f.op_key, f.path, CASE WHEN f.precondition = 'absent' OR f.expected_rev < d.rev THEN 'match' ELSE f.precondition END AS precondition,
  CASE WHEN f.precondition = 'absent' OR f.expected_rev < d.rev THEN d.rev ELSE f.expected_rev END AS expected_rev FROM follow f JOIN done d ON f.vault_id = d.vault_id AND f.path = d.path
UNION ALL SELECT op_key, path, precondition, expected_rev FROM device_ops WHERE state <> 'sent'""",
)
def _resolve_queue(base, device_ops):
    odd = F.col("arrival") % 2 == 1
    follow = device_ops.filter("state = 'sent' and op <> 'rename'").withColumns(
        {"op_key": F.concat(F.lit("after-"), "op_key"), "arrival": F.col("arrival") + 100_000, "state": F.lit("queued"), "op": F.lit("put"),
         "precondition": F.when(odd, "match").otherwise("absent"), "expected_rev": F.when(odd, F.col("arrival") % 5)}
    )
    out = D.resolve_receipts(device_ops.unionByName(follow), _results(device_ops), base)
    return out["device_ops"].select("op_key", "path", "precondition", "expected_rev")


@AREA.add(
    "t19_route_failures", "events",
    sql="""SELECT event_id, CASE WHEN s = 412 THEN 'replan' WHEN s = 401 AND c = 'revoked' THEN 'stop'
  WHEN c IN ('path_collision','operation_expired','text_too_large') OR s IN (401,403,413) THEN 'attention' ELSE 'retry' END AS route,
  CASE WHEN NOT (s = 412 OR c IN ('path_collision','operation_expired','text_too_large') OR s IN (401,403,413)) THEN
    1000 + CAST(least(300000, greatest(2000 * power(2, user_id % 12), coalesce(CASE WHEN event_id % 4 = 0 THEN 90 END, 0) * 1000)) AS BIGINT) END AS retry_at
FROM (SELECT event_id, user_id, CASE event_id % 8 WHEN 0 THEN 412 WHEN 1 THEN 401 WHEN 2 THEN 401 WHEN 3 THEN 403 WHEN 4 THEN 409 WHEN 5 THEN 409 WHEN 6 THEN 413 ELSE 503 END AS s,
  CASE event_id % 8 WHEN 1 THEN 'revoked' WHEN 4 THEN 'path_collision' WHEN 5 THEN 'idempotency_in_progress' WHEN 6 THEN 'text_too_large' WHEN 7 THEN 'importing' END AS c FROM events) t""",
)
def _route(events):
    kind = F.col("event_id") % 8
    statuses = F.array(*map(F.lit, [412, 401, 401, 403, 409, 409, 413, 503]))
    codes = F.array(*[F.lit(c).cast("string") for c in [None, "revoked", None, None, "path_collision", "idempotency_in_progress", "text_too_large", "importing"]])
    failures = events.select(
        "event_id", F.get(statuses, kind).alias("status"), F.get(codes, kind).alias("code"), (F.col("user_id") % 12).alias("attempts"),
        F.when(F.col("event_id") % 4 == 0, 90).alias("retry_after"), F.lit(1000).cast("long").alias("now_ms"),
    )
    return D.route_failures(failures).select("event_id", "route", "retry_at")


@AREA.add(
    "t20_hold_destructive", "local_events", "event_base",
    steps={"seen": "SELECT *, CASE WHEN event = 'create' THEN regexp_replace(path, '/(p[0-9])', '/.\\1') || '.icloud' ELSE path END AS p FROM local_events"},
    sql="""SELECT s.vault_id, s.arrival, s.p AS path, b.rev AS observed_rev, CASE WHEN s.event = 'create' THEN s.path END AS unavailable_path,
  CASE WHEN s.event IN ('delete','rename') THEN 'held' WHEN s.event = 'create' THEN 'unavailable' ELSE 'pass' END AS verdict
FROM seen s LEFT JOIN event_base b ON s.vault_id = b.vault_id AND s.p = b.path""",
)
def _hold(events, base):
    hidden = F.concat(F.regexp_replace("path", "/(p[0-9])", "/.$1"), F.lit(".icloud"))
    seen = events.withColumn("path", F.when(F.col("event") == "create", hidden).otherwise(F.col("path")))
    out = D.hold_destructive(seen, base.withColumn("stale", F.lit(False)))
    return out.select("vault_id", "arrival", "path", "observed_rev", "unavailable_path", "verdict")


@AREA.add(
    "j18_stale_confirmations", "local_events", "event_base",
    steps={"c": "SELECT e.vault_id, e.arrival, e.path, CASE WHEN arrival % 3 = 0 THEN b.rev + 1 ELSE b.rev END AS r, b.deleted AS d, CASE WHEN arrival % 4 = 0 THEN 'old' ELSE 'new' END AS ep, b.rev AS br FROM local_events e LEFT JOIN event_base b ON e.vault_id = b.vault_id AND e.path = b.path WHERE e.event IN ('delete','rename')"},
    sql="SELECT vault_id, arrival, path, r IS NULL OR r <> br OR ep <> 'new' AS is_stale FROM c",
)
def _stale(events, base):
    known = base.withColumn("stale", F.lit(False))
    held = (
        events.filter("event in ('delete', 'rename')").select("device_id", "vault_id", "path", "arrival").join(
            base.select("device_id", "vault_id", "path", F.col("rev").alias("observed_rev"), F.col("hash").alias("observed_hash"), F.col("deleted").alias("observed_deleted")),
            ["device_id", "vault_id", "path"], "left",
        )
    )
    held = held.withColumns(
        {"observed_rev": F.when(F.col("arrival") % 3 == 0, F.col("observed_rev") + 1).otherwise(F.col("observed_rev")),
         "observed_epoch": F.when(F.col("arrival") % 4 == 0, "old").otherwise("new")}
    )
    epochs = events.select("vault_id").distinct().withColumn("epoch", F.lit("new"))
    return D.stale_confirmations(held, known, epochs).select("vault_id", "arrival", "path", "is_stale")


_EVENT_STEPS = {
    "here": "SELECT DISTINCT vault_id, path, hash AS lh FROM (SELECT vault_id, path, max(hash) AS hash FROM local_events WHERE path LIKE '%3/p%' OR event = 'x' GROUP BY vault_id, path) t",
    "there": "SELECT vault_id, to_path, min(hash) AS th FROM local_events WHERE to_path LIKE '%4/q%' GROUP BY vault_id, to_path",
    "puts": """SELECT vault_id, path, max(state = 'queued') AS qp, min(CASE WHEN state = 'sent' THEN op_key END) AS sc, max(state = 'sent') AS sp FROM open_puts GROUP BY vault_id, path""",
    "j": """SELECT e.*, b.rev AS br, b.hash AS bh, b.deleted AS bd, h.lh, t.th, p.qp, p.sc, p.sp, CASE WHEN e.arrival % 6 = 0 THEN b.rev + 1 ELSE b.rev END AS seen_rev
FROM local_events e LEFT JOIN event_base b ON e.vault_id = b.vault_id AND e.path = b.path LEFT JOIN here h ON e.vault_id = h.vault_id AND e.path = h.path
LEFT JOIN there t ON e.vault_id = t.vault_id AND e.to_path = t.to_path LEFT JOIN puts p ON e.vault_id = p.vault_id AND e.path = p.path""",
    "acts": """SELECT *, CASE WHEN event IN ('create','modify') THEN CASE WHEN NOT bd AND bh = hash THEN 'none' ELSE 'put' END
  WHEN (seen_rev IS DISTINCT FROM br) OR lh IS NOT NULL THEN CASE WHEN event = 'delete' THEN 'attention' WHEN th IS NOT NULL THEN 'put_target' ELSE 'none' END
  WHEN event = 'delete' AND (br IS NULL OR bd) THEN CASE WHEN sc IS NOT NULL THEN 'delete_after' WHEN qp THEN 'discard_queued' ELSE 'none' END
  WHEN event = 'delete' THEN 'delete' WHEN br IS NULL AND qp AND NOT sp THEN CASE WHEN th IS NULL THEN 'none' ELSE 'relocate_create' END
  WHEN NOT bd THEN 'rename' ELSE 'none' END AS action FROM j""",
}
VIEWS["open_puts"] = """
SELECT DISTINCT 'd1' AS device_id, vault_id, path, concat('k-', path) AS op_key, 'put' AS op, CAST(NULL AS STRING) AS to_path,
  CASE WHEN path LIKE '%0/p%' THEN 'sent' ELSE 'queued' END AS state, 'absent' AS precondition
FROM local_events WHERE path LIKE '%2/p%' OR path LIKE '%1/p%' OR path LIKE '%0/p%'"""


@AREA.add(
    "t28_events_to_ops", "local_events", "event_base", "open_puts", steps=_EVENT_STEPS,
    sql="""SELECT vault_id, arrival, event, path, action, CASE WHEN action IN ('put','delete','rename') THEN br END AS expected_rev, CASE WHEN action = 'delete_after' THEN sc END AS depends_on FROM acts""",
)
def _to_ops(events, base, puts):
    here = events.filter(F.col("path").like("%3/p%")).groupBy("device_id", "vault_id", "path").agg(F.max("hash").alias("hash"))
    there = events.filter(F.col("to_path").like("%4/q%")).groupBy("device_id", "vault_id", F.col("to_path").alias("path")).agg(F.min("hash").alias("hash"))
    local = here.unionByName(there).withColumn("size", F.lit(10).cast("long"))
    seen = events.join(base.select("device_id", "vault_id", "path", "rev"), ["device_id", "vault_id", "path"], "left").withColumn(
        "observed_rev", F.when(F.col("arrival") % 6 == 0, F.col("rev") + 1).otherwise(F.col("rev"))
    ).drop("rev")
    out = D.events_to_ops(seen, local, base.withColumn("stale", F.lit(False)), puts)
    return out.select("vault_id", "arrival", "event", "path", "action", "expected_rev", "depends_on")


@AREA.add(
    "t27_empty_folders", "notes",
    steps={
        "up": "SELECT vault_id, deleted, unnest([split_part(path, '/', 1), concat(split_part(path, '/', 1), '/', split_part(path, '/', 2))]) AS folder FROM notes",
    },
    sql="SELECT DISTINCT vault_id, folder FROM up WHERE deleted AND concat(vault_id, folder) NOT IN (SELECT concat(vault_id, folder) FROM up WHERE NOT deleted)",
)
def _folders(notes):
    return D.empty_folders(notes.filter("deleted"), notes.filter(~F.col("deleted")))


@AREA.add(
    "t25_expired_recovery", "pages", "labels",
    steps={"tree": "SELECT page_id, SHA(html) AS h, CASE WHEN page_id % 7 = 0 THEN SHA(url) ELSE SHA(html) END AS n, 1700000000000 + page_id * 86400000 AS mtime FROM pages"},
    sql=f"""SELECT 'd1' AS device_id, concat('v', CAST(page_id % 3 AS STRING)) AS vault_id, concat('.vault-sync/pre-apply/', n) AS path FROM tree
WHERE n = h AND mtime <= {_NOW} - 604800000 AND page_id NOT IN (SELECT doc_id FROM labels)""",
)
def _recovery(pages, labels):
    body = F.sha2("html", 256)
    name = F.when(F.col("page_id") % 7 == 0, F.sha2("url", 256)).otherwise(body)
    tree = pages.select(
        "page_id", F.lit("d1").alias("device_id"), F.concat(F.lit("v"), F.col("page_id") % 3).alias("vault_id"),
        F.concat(F.lit(".vault-sync/pre-apply/"), name).alias("path"), body.alias("hash"), (F.lit(1700000000000) + F.col("page_id") * 86_400_000).alias("mtime"),
    )
    open_copies = tree.join(labels.select(F.col("doc_id").alias("page_id")), "page_id", "left_semi")
    return D.expired_recovery(tree, open_copies, _NOW)


@AREA.add(
    "a15_device_status", "customer", "queue", "feed",
    steps={
        "devs": """SELECT concat('d', CAST(c_custkey AS STRING)) AS device_id, concat('v', CAST(c_custkey % 3 AS STRING)) AS vault_id, c_custkey % 11 = 0 AS revoked, c_custkey % 7 = 0 AS paused,
  c_custkey % 13 <> 0 AS connected, c_custkey % 5 = 0 AS active, c_custkey % 6 = 0 AS failed, CASE WHEN c_custkey % 2 = 0 THEN 9 ELSE 8 END AS cursor FROM customer""",
        "n": "SELECT device_id, vault_id, count(*) AS open_ops FROM queue WHERE state <> 'resolved' GROUP BY ALL",
        "a": "SELECT device_id, vault_id, count(*) AS attention_items FROM feed WHERE op = 'delete' GROUP BY ALL",
        "p": "SELECT concat('d', CAST(arrival % 200 AS STRING)) AS device_id, concat('v', CAST(arrival % 200 % 3 AS STRING)) AS vault_id, count(*) AS open_plans FROM queue WHERE op = 'rename' GROUP BY ALL",
        "h": "SELECT concat('d', CAST(arrival % 300 AS STRING)) AS device_id, concat('v', CAST(arrival % 300 % 3 AS STRING)) AS vault_id, count(*) AS held_items FROM queue WHERE op = 'delete' GROUP BY ALL",
    },
    sql="""SELECT d.device_id, d.vault_id, CASE WHEN revoked THEN 'revoked' WHEN paused THEN 'paused' WHEN NOT connected THEN 'disconnected' WHEN a.attention_items > 0 THEN 'attention'
  WHEN active THEN 'syncing' WHEN failed THEN 'pending' WHEN n.open_ops IS NULL AND p.open_plans IS NULL AND h.held_items IS NULL AND cursor = 9 THEN 'settled' ELSE 'pending' END AS status,
  coalesce(n.open_ops, 0) AS open_ops, coalesce(p.open_plans, 0) AS open_plans, coalesce(a.attention_items, 0) AS attention_items, coalesce(h.held_items, 0) AS held_items
FROM devs d LEFT JOIN p ON d.device_id = p.device_id AND d.vault_id = p.vault_id LEFT JOIN h ON d.device_id = h.device_id AND d.vault_id = h.vault_id LEFT JOIN n ON d.device_id = n.device_id AND d.vault_id = n.vault_id LEFT JOIN a ON d.device_id = a.device_id AND d.vault_id = a.vault_id""",
)
def _status(customer, queue, feed):
    k = F.col("c_custkey")
    devices = customer.select(
        F.concat(F.lit("d"), k).alias("device_id"), F.concat(F.lit("v"), k % 3).alias("vault_id"), (k % 11 == 0).alias("revoked"),
        (k % 7 == 0).alias("paused"), (k % 13 != 0).alias("connected"), (k % 5 == 0).alias("active"), (k % 6 == 0).alias("failed"),
        F.lit(EPOCH).alias("epoch"), F.when(k % 2 == 0, 9).otherwise(8).alias("cursor"),
    )
    heads = customer.select(F.concat(F.lit("v"), k % 3).alias("vault_id")).distinct().withColumns({"head_epoch": F.lit(EPOCH), "head_seq": F.lit(9)})
    dealt = lambda op, n: queue.filter(F.col("op") == op).select(
        F.concat(F.lit("d"), F.col("arrival") % n).alias("device_id"), F.concat(F.lit("v"), F.col("arrival") % n % 3).alias("vault_id")
    )
    return D.device_status(devices, queue, dealt("rename", 200), feed.filter("op = 'delete'"), dealt("delete", 300), heads)


def _burst_sql(gap: int) -> str:
    return f"""SELECT device_id, vault_id, min(at_ms) AS first_at, max(at_ms) AS last_at, count(*) AS events, max(at_ms) + {gap} AS flush_at FROM (
  SELECT *, sum(CASE WHEN gap IS NULL OR gap >= {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY device_id, vault_id ORDER BY arrival) AS burst FROM (
    SELECT *, at_ms - lag(at_ms) OVER (PARTITION BY device_id, vault_id ORDER BY arrival) AS gap FROM local_events) a) b
GROUP BY device_id, vault_id, burst"""


@AREA.add("t12_debounce_events", "local_events", sql=_burst_sql(2_000))
def _debounce(events):
    return debounce_events(events)


@AREA.add("t12_debounce_ten_minutes", "local_events", sql=_burst_sql(600_000))
def _debounce_long(events):
    return debounce_events(events, 600_000)
