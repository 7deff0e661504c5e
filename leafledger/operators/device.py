"""Device side: replay, apply plans, reconciliation, and the outgoing queue.

Keys are (device_id, vault_id, path). ``local`` holds path, hash, size; ``base`` holds
rev, hash, deleted, stale; a change holds op, path, rev, hash and for renames from_path,
from_rev. Nothing here ever derives a delete from a missing row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.paths import DEFAULT_POLICY, ancestors, conflict_name, enrollment_scope, placeholder_source
from ..functions.unicode import path_key
from ..session import arrival_rank, neighbour

KEYS = ["device_id", "vault_id", "path"]
DEVICE = ["device_id", "vault_id"]


def _prefixed(df: DataFrame, columns: list[str], prefix: str, path: str = "path") -> DataFrame:
    return df.select(*DEVICE, F.col("path").alias(path), *[F.col(c).alias(prefix + c) for c in columns])


def _local(local: DataFrame, prefix: str = "l_", path: str = "path") -> DataFrame:
    return _prefixed(local, ["hash", "size"], prefix, path)


def _base(base: DataFrame, prefix: str = "b_", path: str = "path") -> DataFrame:
    return _prefixed(base, ["rev", "hash", "deleted", "stale"], prefix, path)


def _is(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


# ---- feed ------------------------------------------------------------------


def replay_feed(feed: DataFrame, base: DataFrame) -> DataFrame:
    """Feed rows still to apply: renames, unknown paths, newer revisions, stale bases."""
    known = _base(base).select(*KEYS, "b_rev", "b_stale")
    pending = (F.col("op") == "rename") | F.col("b_rev").isNull() | (F.col("rev") > F.col("b_rev")) | F.col("b_stale")
    return feed.join(known, KEYS, "left").filter(pending).drop("b_rev", "b_stale")


def touched_keys(df: DataFrame, other: str) -> DataFrame:
    """One row per path key that a row touches: its path and, for renames, the other side."""
    both = F.array_compact(F.array("path", F.when(F.col("op") == "rename", F.col(other))))
    return df.withColumn("_p", F.explode(both)).withColumn("path_key", path_key(F.col("_p"))).drop("_p")


def fence_feed(feed: DataFrame, device_ops: DataFrame) -> DataFrame:
    """Feed rows before the first one that meets an unresolved sent operation of the device."""
    sent = touched_keys(device_ops.filter("state = 'sent'"), "to_path").select(*DEVICE, "path_key").distinct()
    blocked = touched_keys(feed.select(*DEVICE, "seq", "op", "path", "from_path"), "from_path").join(
        sent, [*DEVICE, "path_key"], "left_semi"
    )
    stop = blocked.groupBy(*DEVICE).agg(F.min("seq").alias("_stop"))
    return feed.join(stop, DEVICE, "left").filter("_stop is null or seq < _stop").drop("_stop")


def classify_deletes(deletes: DataFrame, manifest: DataFrame) -> DataFrame:
    """Feed deletes against the manifest: exact tombstone, superseded, or unconfirmed."""
    row = manifest.select("vault_id", "path", F.col("rev").alias("m_rev"), F.col("seq").alias("m_seq"),
                          F.col("deleted").alias("m_deleted"), F.col("kind").alias("m_kind"))
    newer = (F.col("m_rev") > F.col("rev")) & (F.col("m_seq") > F.col("seq"))
    exact = (F.col("m_rev") == F.col("rev")) & (F.col("m_seq") == F.col("seq")) & F.col("m_deleted")
    return deletes.join(row, ["vault_id", "path"], "left").select(
        *deletes.columns, F.when(newer, "superseded").when(exact, F.col("m_kind")).otherwise("unconfirmed").alias("verdict")
    )


# ---- apply plans -----------------------------------------------------------

_COPY = ("copy_then_replace", "copy_then_trash", "keep_remote_copy")


def plan_apply(changes: DataFrame, local: DataFrame, base: DataFrame, device_name: Column | str, policy=DEFAULT_POLICY) -> DataFrame:
    """Action, copy name and new base of every put or delete for its device.

    A local path that differs only by case is found through its key.
    """
    joined = changes.join(_local(local), KEYS, "left").join(_base(base), KEYS, "left")
    joined = joined.withColumn("path_key", path_key(F.col("path")))
    twins = local.select(*DEVICE, path_key(F.col("path")).alias("path_key"), F.lit(True).alias("_twin")).distinct()
    joined = joined.join(twins, [*DEVICE, "path_key"], "left")
    put, absent = F.col("op") == "put", F.col("l_hash").isNull()
    clean = _is(~F.col("b_deleted") & (F.col("l_hash") == F.col("b_hash")))
    ignore = F.col("b_rev").isNotNull() & (F.col("rev") <= F.col("b_rev")) & ~F.col("b_stale")
    scope = enrollment_scope(F.col("path"), F.coalesce("l_size", F.lit(0)), policy)
    action = (
        F.when(ignore, "ignore")
        .when(scope == "excluded", "ignore")
        .when(scope == "unsupported", "attention")
        .when(put & _is(F.col("l_hash") == F.col("hash")), "none")
        .when(put & absent & _is(F.col("_twin")), "keep_remote_copy")
        .when(put & absent, "create")
        .when(put, F.when(clean, "replace").otherwise("copy_then_replace"))
        .when(absent, "none")
        .otherwise(F.when(clean, "trash").otherwise("copy_then_trash"))
    )
    advance = ~F.col("action").isin("ignore", "attention")
    name = conflict_name(F.col("path"), device_name, F.col("rev"), F.col("at_ms"), policy)
    return joined.withColumn("action", action).select(
        *changes.columns, "action",
        F.when(F.col("action").isin(*_COPY), name).alias("copy_path"),
        F.when(advance, F.col("rev")).otherwise(F.col("b_rev")).alias("new_rev"),
        F.when(advance, F.when(put, F.col("hash"))).otherwise(F.col("b_hash")).alias("new_hash"),
        F.when(advance, ~put).otherwise(F.col("b_deleted")).alias("new_deleted"),
    )


def plan_rename(renames: DataFrame, local: DataFrame, base: DataFrame, device_name: Column | str, policy=DEFAULT_POLICY) -> DataFrame:
    """Per side of a remote rename: pending, clean, and what to do with it."""
    joined = (
        renames.join(_local(local, "ls_", "from_path"), [*DEVICE, "from_path"], "left")
        .join(_base(base, "bs_", "from_path"), [*DEVICE, "from_path"], "left")
        .join(_local(local, "ld_"), KEYS, "left")
        .join(_base(base, "bd_"), KEYS, "left")
    )
    source_pending = F.col("bs_rev").isNotNull() & ((F.col("bs_rev") < F.col("from_rev")) | F.col("bs_stale"))
    target_pending = F.col("bd_rev").isNull() | (F.col("bd_rev") < F.col("rev")) | F.col("bd_stale")
    source_clean = _is(~F.col("bs_deleted") & (F.col("ls_hash") == F.col("bs_hash")))
    target_clean = _is(~F.col("bd_deleted") & (F.col("ld_hash") == F.col("bd_hash")))
    no_target = F.col("ld_hash").isNull()
    action = (
        F.when(~source_pending & ~target_pending, "noop")
        .when(source_pending & target_pending & source_clean & no_target, "local_rename")
        .otherwise("two_sides")
    )
    two = F.col("action") == "two_sides"
    source = F.when(~source_pending, "skip").when(F.col("ls_hash").isNull(), "none").when(source_clean, "trash").otherwise("copy_then_trash")
    target = (
        F.when(~target_pending, "skip").when(_is(F.col("ld_hash") == F.col("hash")), "none").when(no_target, "create")
        .when(target_clean, "replace").otherwise("copy_then_replace")
    )
    return joined.withColumn("action", action).select(
        *renames.columns, source_pending.alias("source_pending"), target_pending.alias("target_pending"), "action",
        F.when(two, source).alias("source_action"), F.when(two, target).alias("target_action"),
        F.when(two & (source == "copy_then_trash"), conflict_name(F.col("from_path"), device_name, F.col("from_rev"), F.col("at_ms"), policy)).alias("source_copy"),
        F.when(two & (target == "copy_then_replace"), conflict_name(F.col("path"), device_name, F.col("rev"), F.col("at_ms"), policy)).alias("target_copy"),
    )


def rank_copies(plans: DataFrame) -> DataFrame:
    """First planned copy per (device, path, rev); a retry finds the same name again."""
    copies = plans.filter(F.col("copy_path").isNotNull())
    return copies.groupBy(*KEYS, "rev").agg(F.min_by(F.struct("seq", "copy_path"), "seq").alias("c")).select(
        *KEYS, "rev", F.col("c.seq").alias("seq"), F.col("c.copy_path").alias("copy_path")
    )


def reconcile(devices: DataFrame, local: DataFrame, base: DataFrame, manifest: DataFrame, device_name: Column | str, now_ms: int, policy=DEFAULT_POLICY) -> DataFrame:
    """Three-way plan over local, base and manifest. Local-only paths become creates;
    a path known only to the base yields nothing: missing is not deleted."""
    remote = manifest.select("vault_id", "path", "rev", "seq", "hash", "deleted", "kind")
    remote = remote.join(devices.select(*DEVICE), "vault_id")
    changes = remote.select(
        *KEYS, "seq", "rev", F.when(F.col("deleted"), "delete").otherwise("put").alias("op"),
        F.when(F.col("deleted"), "").otherwise(F.col("hash")).alias("hash"), F.lit(now_ms).cast("long").alias("at_ms"),
    )
    # Bytes that already equal the manifest row only confirm the base, whatever its revision.
    planned = plan_apply(changes, local, base, device_name, policy)
    same = planned.join(_local(local), KEYS, "left").select(
        *KEYS, "rev",
        F.when((F.col("op") == "put") & _is(F.col("l_hash") == F.col("hash")) & ~F.col("action").isin("attention")
               & (enrollment_scope(F.col("path"), F.lit(0), policy) != "excluded"), "none").otherwise(F.col("action")).alias("action"),
        "copy_path",
    )
    scope = enrollment_scope(F.col("path"), F.col("size"), policy)
    creates = local.join(remote.select(*KEYS), KEYS, "left_anti").filter(scope != "excluded").select(
        *KEYS, F.lit(None).cast("long").alias("rev"),
        F.when(scope == "unsupported", "attention").otherwise("publish_create").alias("action"),
        F.lit(None).cast("string").alias("copy_path"),
    )
    return same.unionByName(creates)


def reconcile_sets(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Side of every path: ``local_only``, ``remote_only`` or ``both``."""
    keys = ["vault_id", "path"]
    sides = local.select(*keys, F.lit(1).alias("s")).unionByName(remote.select(*keys, F.lit(2).alias("s")))
    both = sides.groupBy(*keys).agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    return both.select(*keys, F.when(F.col("lo") != F.col("hi"), "both").when(F.col("lo") == 1, "local_only").otherwise("remote_only").alias("side"))


def union_paths(remote: DataFrame, resolved: DataFrame) -> DataFrame:
    """Remote paths and paths just resolved, once each."""
    return remote.select("vault_id", "path").unionByName(resolved.select("vault_id", "path")).distinct()


# ---- outgoing queue --------------------------------------------------------


def detect_changes(local: DataFrame, base: DataFrame, device_ops: DataFrame, unavailable: DataFrame | None = None, policy=DEFAULT_POLICY) -> DataFrame:
    """Puts for local files that differ from their base and are not already queued."""
    open_ops = device_ops.filter("state <> 'resolved'")
    queued = open_ops.filter("op = 'put'").select(*KEYS, F.col("payload_hash").alias("hash"))
    targets = open_ops.filter("op = 'rename'").select(*DEVICE, path_key(F.col("to_path")).alias("path_key"))
    rows = local.withColumn("path_key", path_key(F.col("path"))).join(targets, [*DEVICE, "path_key"], "left_anti")
    if unavailable is not None:
        rows = rows.join(unavailable.select(*KEYS), KEYS, "left_anti")
    scope = enrollment_scope(F.col("path"), F.col("size"), policy)
    rows = rows.withColumn("scope", scope).filter("scope <> 'excluded'").join(_base(base), KEYS, "left")
    unchanged = _is(~F.col("b_deleted") & (F.col("b_hash") == F.col("hash")))
    changed = rows.filter((F.col("scope") == "unsupported") | ~unchanged)
    changed = changed.join(queued.withColumn("_q", F.lit(True)).distinct(), [*KEYS, "hash"], "left").filter(
        (F.col("scope") == "unsupported") | F.col("_q").isNull()
    )
    return changed.select(
        *KEYS, "hash", "size",
        F.when(F.col("scope") == "unsupported", "attention").otherwise("put").alias("op"),
        F.when(F.col("scope") != "unsupported", F.when(F.col("b_rev").isNull(), "absent").otherwise("match")).alias("precondition"),
        F.when(F.col("scope") != "unsupported", F.col("b_rev")).alias("expected_rev"),
    )


def missing_to_restore(base: DataFrame, local: DataFrame, device_ops: DataFrame, unavailable: DataFrame | None = None, policy=DEFAULT_POLICY) -> DataFrame:
    """Live base paths without a local file: to be restored, never deleted remotely."""
    keyed = base.filter(~F.col("deleted")).withColumn("path_key", path_key(F.col("path")))
    keyed = keyed.filter(enrollment_scope(F.col("path"), F.lit(0), policy) != "excluded")
    present = local.select(*DEVICE, path_key(F.col("path")).alias("path_key"))
    leaving = device_ops.filter("op in ('delete', 'rename') and state <> 'resolved'").select(*DEVICE, path_key(F.col("path")).alias("path_key"))
    out = keyed.join(present, [*DEVICE, "path_key"], "left_anti").join(leaving, [*DEVICE, "path_key"], "left_anti")
    if unavailable is not None:
        out = out.join(unavailable.select(*KEYS), KEYS, "left_anti")
    return out.select(*KEYS, "rev", "hash")


def ack_creates(device_ops: DataFrame, manifest: DataFrame) -> DataFrame:
    """Sent creates that the manifest confirms by path key and hash, with their new base."""
    sent = device_ops.filter("state = 'sent' and op = 'put' and precondition = 'absent'").select(
        *DEVICE, "op_key", path_key(F.col("path")).alias("path_key"), F.col("payload_hash").alias("hash")
    )
    live = manifest.filter(~F.col("deleted")).select("vault_id", "path", path_key(F.col("path")).alias("path_key"), "rev", "hash")
    return sent.join(live, ["vault_id", "path_key", "hash"]).select(*DEVICE, "op_key", "path", "rev", "hash")


def coalesce_ops(device_ops: DataFrame) -> DataFrame:
    """Unresolved queue after coalescing: a queued operation falls to the next operation
    that touches any of its path keys when that one has the same type and source path."""
    open_ops = device_ops.filter("state <> 'resolved'").withColumn("source_key", path_key(F.col("path")))
    keyed = touched_keys(open_ops, "to_path").select(*DEVICE, "arrival", "path_key", "op", "source_key")
    keyed = keyed.dropDuplicates([*DEVICE, "arrival", "path_key"])
    following = neighbour(keyed, [*DEVICE, "path_key"], "arrival", F.struct("arrival", "op", "source_key"), "_next", forward=True)
    nearest = following.filter(F.col("_next").isNotNull()).groupBy(*DEVICE, "arrival").agg(F.min("_next").alias("_next"))
    replaced = (F.col("state") == "queued") & (F.col("_next.op") == F.col("op")) & (F.col("_next.source_key") == F.col("source_key"))
    return open_ops.join(nearest, [*DEVICE, "arrival"], "left").filter(~_is(replaced)).drop("_next", "source_key")


def drop_echoes(events: DataFrame, expected: DataFrame) -> DataFrame:
    """Events without the first one per path whose hash equals the expected write."""
    wanted = expected.select(*KEYS, "hash").distinct()
    first = events.join(wanted, [*KEYS, "hash"], "left_semi").groupBy(*KEYS, "hash").agg(F.min("arrival").alias("arrival"))
    return events.join(first, [*KEYS, "hash", "arrival"], "left_anti")


def reset_epoch(devices: DataFrame, base: DataFrame, device_ops: DataFrame, epochs: DataFrame) -> dict[str, DataFrame]:
    """State after an epoch change: bases stale, cursor dropped, open operations → attention."""
    now = epochs.select("vault_id", F.col("epoch").alias("new_epoch"))
    changed = devices.join(now, "vault_id").withColumn("reset", ~F.col("epoch").eqNullSafe(F.col("new_epoch")))
    moved = changed.filter("reset").select(*DEVICE, F.lit(True).alias("_reset"))
    flagged = base.join(moved, DEVICE, "left")
    return {
        "devices": changed.select(*DEVICE, F.col("new_epoch").alias("epoch"), F.when(~F.col("reset"), F.col("cursor")).alias("cursor")),
        "base": flagged.withColumn("stale", F.col("stale") | F.col("_reset").isNotNull()).drop("_reset"),
        "device_ops": device_ops.join(moved, DEVICE, "left_anti"),
        "attention": device_ops.join(moved, DEVICE, "left_semi").select(
            *DEVICE, "path", "op_key", F.lit("epoch_replaced").alias("reason")
        ),
    }


def resolve_receipts(device_ops: DataFrame, results: DataFrame, base: DataFrame) -> dict[str, DataFrame]:
    """Receipts of sent operations: new bases, rebased successors, blocked deletes.

    ``results`` has op_key, rev, hash, deleted. A newer feed base wins over the receipt. Should
    several sent operations of one path have receipts, the one with the newest revision counts.
    """
    done = device_ops.filter("state = 'sent'").join(
        results.select("device_id", "op_key", F.col("rev").alias("r_rev"), F.col("hash").alias("r_hash"), F.col("deleted").alias("r_deleted")),
        ["device_id", "op_key"],
    ).withColumn("receipt_path", F.when(F.col("op") == "rename", F.col("to_path")).otherwise(F.col("path")))
    newest = done.groupBy(*DEVICE, F.col("receipt_path").alias("path")).agg(
        F.max_by(F.struct("r_rev", "r_hash", "r_deleted", F.col("arrival").alias("r_arrival"), F.col("op_key").alias("r_key")), F.struct("r_rev", "arrival")).alias("_n")
    )
    fresh = newest.select(*DEVICE, "path", "_n.*")
    merged = base.join(fresh, KEYS, "full_outer")
    take = F.col("r_rev").isNotNull() & (F.col("rev").isNull() | (F.col("rev") <= F.col("r_rev")))
    bases = merged.select(
        *KEYS, F.when(take, F.col("r_rev")).otherwise(F.col("rev")).alias("rev"),
        F.when(take, F.col("r_hash")).otherwise(F.col("hash")).alias("hash"),
        F.when(take, F.col("r_deleted")).otherwise(F.col("deleted")).alias("deleted"),
        F.when(take, F.lit(False)).otherwise(F.col("stale")).alias("stale"),
    )
    waiting = device_ops.join(done.select(*DEVICE, "op_key"), [*DEVICE, "op_key"], "left_anti").join(fresh, KEYS, "left")
    after = _is((F.col("state") == "queued") & (F.col("arrival") > F.col("r_arrival")))
    rebase = after & ((F.col("precondition") == "absent") | (F.col("expected_rev") < F.col("r_rev")))
    bound = F.col("depends_on").isNotNull() & (F.col("depends_on") == F.col("r_key"))
    confirmed = bases.select(*KEYS, F.col("rev").alias("n_rev"), F.col("hash").alias("n_hash"))
    waiting = waiting.join(confirmed, KEYS, "left")
    blocked = _is(bound & (F.col("op") == "delete") & ~((F.col("n_rev") == F.col("r_rev")) & F.col("n_hash").eqNullSafe(F.col("r_hash"))))
    columns = [c for c in device_ops.columns if c not in ("precondition", "expected_rev", "depends_on")]
    queue = waiting.filter(~blocked).select(
        *columns, F.when(rebase, "match").otherwise(F.col("precondition")).alias("precondition"),
        F.when(rebase, F.col("r_rev")).otherwise(F.col("expected_rev")).alias("expected_rev"),
        F.when(~_is(bound), F.col("depends_on")).alias("depends_on"),
    )
    attention = waiting.filter(blocked).select(*DEVICE, "path", "op_key", F.lit("delete_target_changed").alias("reason"))
    return {"base": bases, "device_ops": queue, "attention": attention}


# Failure codes that end an operation with an owner item.
TERMINAL_CODES = ["path_collision", "text_too_large", "blob_too_large", "operation_expired", "idempotency_mismatch"]


def route_failures(failures: DataFrame) -> DataFrame:
    """``replan`` on a failed precondition, ``stop`` when revoked, ``attention`` for final refusals, else ``retry``."""
    final = F.col("code").isin(*TERMINAL_CODES) | F.col("status").isin(401, 403, 413)
    return failures.withColumn(
        "route",
        F.when(F.col("status") == 412, "replan").when((F.col("status") == 401) & _is(F.col("code") == "revoked"), "stop")
        .when(_is(final), "attention").otherwise("retry"),
    ).withColumn(
        "retry_at",
        F.when(
            F.col("route") == "retry",
            F.col("now_ms") + F.least(F.lit(300_000.0), F.greatest(F.lit(2_000.0) * F.pow(F.lit(2.0), "attempts"), F.coalesce("retry_after", F.lit(0)) * F.lit(1_000.0))).cast("long"),
        ),
    )


def hold_destructive(events: DataFrame, base: DataFrame, policy=DEFAULT_POLICY) -> DataFrame:
    """Deletes and renames by another tool wait with the base they saw; placeholders are unavailable."""
    landed = F.when(F.col("event") == "rename", F.col("to_path")).otherwise(F.col("path"))
    destructive = F.col("event").isin("delete", "rename") & (enrollment_scope(F.col("path"), F.lit(0), policy) != "excluded")
    seen = _base(base).select(*KEYS, F.col("b_rev").alias("observed_rev"), F.col("b_hash").alias("observed_hash"), F.col("b_deleted").alias("observed_deleted"))
    return (
        events.withColumns({"unavailable_path": placeholder_source(landed), "held": destructive})
        .join(seen, KEYS, "left")
        .withColumn("verdict", F.when(F.col("held"), "held").when(F.col("unavailable_path").isNotNull(), "unavailable").otherwise("pass"))
        .drop("held")
    )


def stale_confirmations(confirmations: DataFrame, base: DataFrame, epochs: DataFrame) -> DataFrame:
    """Held items whose observation no longer names the current base revision."""
    now = epochs.select("vault_id", "epoch")
    joined = confirmations.join(_base(base), KEYS, "left").join(now, "vault_id", "left")
    same = (
        F.col("b_rev").eqNullSafe(F.col("observed_rev"))
        & F.col("b_deleted").eqNullSafe(F.col("observed_deleted"))
        & (_is(F.col("b_deleted")) | F.col("b_hash").eqNullSafe(F.col("observed_hash")))
    )
    stale = F.col("observed_rev").isNull() | ~same | _is(F.col("b_stale")) | ~F.col("epoch").eqNullSafe(F.col("observed_epoch"))
    return joined.select(*confirmations.columns, stale.alias("is_stale"))


def events_to_ops(events: DataFrame, local: DataFrame, base: DataFrame, device_ops: DataFrame, policy=DEFAULT_POLICY) -> DataFrame:
    """Outgoing work of live events against the state at the start of the batch.

    Deletes and renames count only as explicit events over an unchanged base whose source
    is really gone; ``observed_rev`` is the base revision when the event was seen.
    """
    open_ops = device_ops.filter("state <> 'resolved' and op = 'put'")
    puts = open_ops.groupBy(*KEYS).agg(
        F.max(F.col("state") == "queued").alias("queued_put"),
        F.min(F.when((F.col("state") == "sent") & (F.col("precondition") == "absent"), F.col("op_key"))).alias("sent_create"),
        F.max((F.col("state") == "queued") & (F.col("precondition") == "absent")).alias("queued_create"),
        F.max(F.col("state") == "sent").alias("sent_put"),
    )
    landing = open_ops.select(*DEVICE, F.col("path").alias("to_path"), F.lit(True).alias("put_there")).distinct()
    at_target = _local(local, "t_", "to_path")
    rows = events.join(_base(base), KEYS, "left").join(puts, KEYS, "left").join(_local(local), KEYS, "left")
    # Only renames have a destination; the other events would all share one NULL join key.
    moves = rows.filter("event = 'rename'").join(landing, [*DEVICE, "to_path"], "left").join(at_target, [*DEVICE, "to_path"], "left")
    rest = rows.filter("event <> 'rename'").withColumns(
        {"put_there": F.lit(None).cast("boolean"), "t_hash": F.lit(None).cast("string"), "t_size": F.lit(None).cast("long")}
    )
    rows = moves.unionByName(rest)
    live = _is(~F.col("b_deleted"))
    write = F.col("event").isin("create", "modify")
    scope = enrollment_scope(F.col("path"), F.coalesce(F.when(write, F.col("l_size")), F.lit(0)), policy)
    target_scope = enrollment_scope(F.col("to_path"), F.coalesce("t_size", F.lit(0)), policy)
    rename = F.col("event") == "rename"
    stale = ~F.col("observed_rev").eqNullSafe(F.col("b_rev")) | F.col("l_hash").isNotNull()
    no_base = F.col("b_rev").isNull()
    action = (
        F.when(scope == "excluded", "none")
        .when(write & (scope == "unsupported"), "attention")
        .when(write, F.when(live & _is(F.col("b_hash") == F.col("hash")), "none").otherwise("put"))
        .when(rename & (target_scope == "excluded"), "none")
        .when(rename & (target_scope == "unsupported"), "attention")
        .when(stale, F.when(~rename, "attention").when(F.col("t_hash").isNotNull(), "put_target").otherwise("none"))
        .when(~rename & ~live, F.when(F.col("sent_create").isNotNull(), "delete_after").when(F.col("queued_put"), "discard_queued").otherwise("none"))
        .when(~rename, "delete")
        .when(
            no_base & _is(F.col("queued_create")) & ~_is(F.col("sent_put")),
            F.when(F.col("t_hash").isNull(), "none").when(F.col("put_there"), "discard_queued").otherwise("relocate_create"),
        )
        .when(live, "rename")
        .otherwise("none")
    )
    return rows.withColumn("action", action).select(
        *events.columns, "action",
        F.when(F.col("action").isin("put", "delete", "rename"), F.col("b_rev")).alias("expected_rev"),
        F.when(F.col("action") == "delete_after", F.col("sent_create")).alias("depends_on"),
    )


# ---- folders, recovery copies, status ---------------------------------------


def empty_folders(vacated: DataFrame, live: DataFrame) -> DataFrame:
    """Folders above vacated paths that hold no live file any more."""
    above = vacated.select("vault_id", F.explode(ancestors(F.col("path"))).alias("folder")).distinct()
    used = live.select("vault_id", F.explode(ancestors(F.col("path"))).alias("folder")).distinct()
    return above.join(used, ["vault_id", "folder"], "left_anti")


def expired_recovery(tree: DataFrame, open_copies: DataFrame, now_ms: int, prefix: str = DEFAULT_POLICY.private_dir + "/pre-apply/") -> DataFrame:
    """Recovery copies older than seven days whose name is their hash and that no open plan needs."""
    name = F.substring("path", len(prefix) + 1, 512)
    old = (F.col("mtime") <= now_ms - 7 * K.DAY_MS) & name.rlike("^[0-9a-f]{64}$") & (name == F.col("hash"))
    mine = tree.filter(F.col("path").startswith(prefix) & old)
    return mine.join(open_copies.select(*KEYS), KEYS, "left_anti").select(*KEYS)


def apply_order(feed: DataFrame) -> DataFrame:
    """Feed rows of a device with their 1-based place in ascending sequence, the order in which they are applied."""
    return arrival_rank(feed, DEVICE, "seq", "place")


def device_status(devices: DataFrame, device_ops: DataFrame, plans: DataFrame, attention: DataFrame, held: DataFrame, heads: DataFrame) -> DataFrame:
    """Status by precedence: revoked, paused, disconnected, attention, syncing, pending, settled."""

    def count(df, name):
        return df.groupBy(*DEVICE).agg(F.count(F.lit(1)).alias(name))

    out = devices
    counted = {"open_ops": device_ops.filter("state <> 'resolved'"), "open_plans": plans, "attention_items": attention, "held_items": held}
    for name, df in counted.items():
        out = out.join(count(df, name), DEVICE, "left")
    out = out.na.fill(0, list(counted)).join(heads.select("vault_id", "head_epoch", "head_seq"), "vault_id", "left")
    idle = (F.col("open_ops") == 0) & (F.col("open_plans") == 0) & (F.col("held_items") == 0)
    current = _is((F.col("epoch") == F.col("head_epoch")) & (F.col("cursor") == F.col("head_seq")))
    return out.select(
        *DEVICE,
        F.when(F.col("revoked"), "revoked").when(F.col("paused"), "paused").when(~F.col("connected"), "disconnected")
        .when(F.col("attention_items") > 0, "attention").when(F.col("active"), "syncing").when(F.col("failed"), "pending")
        .when(idle & current, "settled").otherwise("pending").alias("status"),
        *counted,
    )
