"""Conditional application of an operation log (compare-and-set per path).

The outcome of an operation depends only on earlier operations that share a path key
or a reused idempotency key, so the log is split into connected components of those
keys. Components run in parallel; inside one, rows stream through a small fold in
arrival order. Operations that everything else can decide (policy, stored receipts,
key age, retained revisions) are decided by joins before the fold.

A component with more than ``max_group_ops`` operations is worked off in arrival
slices of that many rows, with its state carried over in written outcomes. So no task
ever holds or walks an unbounded group, and the result is the same.
"""

from __future__ import annotations

import hashlib
from collections import namedtuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import constants as K
from ..functions.identity import format_etag, key_window
from ..functions.markdown import insert_under
from ..functions.unicode import path_key
from ..session import arrival_rank, cut_lineage

# Optional columns of the log, with the type and value they take when absent.
_DEFAULTS = {
    "to_path": "string", "client_id": "string", "op_key": "string", "fingerprint": "string", "expect": "string",
    "expected_rev": "long", "kind": "string", "size": "long", "payload_hash": "string", "content": "string",
    "heading": "string", "source_rev": "long", "as_conflict_copy": "boolean", "reason": "string", "at_ms": "long",
}
_STATE = {"kind": "string", "size": "long", "content": "string", "renamed_to": "string"}

OUTCOME = (
    "vault_id string, component string, arrival long, accepted boolean, reason string, status int, replay_of long, "
    "rev long, from_rev long, hash string, size long, kind string, deleted boolean, new_content string, "
    "live_delta int, current_rev long, current_hash string, current_deleted boolean, current_renamed_to string, "
    "existing_path string"
)
_FIELDS = [tuple(part.split()) for part in OUTCOME.split(", ")]
_ARROW_TYPES = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
_ARROW = pa.schema([(name, _ARROW_TYPES[kind]) for name, kind in _FIELDS])


def _with_defaults(df: DataFrame, defaults: dict[str, str]) -> DataFrame:
    missing = {c: F.lit(None).cast(t) for c, t in defaults.items() if c not in df.columns}
    return df.withColumns(missing) if missing else df


# ---- components -----------------------------------------------------------


def _is_settled(pairs: DataFrame) -> bool:
    """True if every node points to at most one root and no root points anywhere."""
    ends = pairs.select("vault_id", F.col("hi").alias("node"), F.lit(1).alias("h"), F.lit(0).alias("l")).unionByName(
        pairs.select("vault_id", F.col("lo").alias("node"), F.lit(0).alias("h"), F.lit(1).alias("l"))
    )
    nodes = ends.groupBy("vault_id", "node").agg(F.sum("h").alias("h"), F.max("l").alias("l"))
    return nodes.filter((F.col("h") > 1) | ((F.col("h") > 0) & (F.col("l") > 0))).isEmpty()


def label_components(edges: DataFrame) -> DataFrame:
    """(vault_id, src, dst) → (vault_id, node, component): smallest node of each component.

    Alternating large-star and small-star joins; each round is two aggregations with
    map-side combine, so hub nodes do not collect their neighbours anywhere.
    """
    pairs = cut_lineage(
        edges.select("vault_id", F.greatest("src", "dst").alias("hi"), F.least("src", "dst").alias("lo"))
        .filter("hi <> lo")
        .distinct()
    )
    while not _is_settled(pairs):
        both = pairs.select("vault_id", F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            pairs.select("vault_id", F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        least = both.groupBy("vault_id", "u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = (
            both.filter("v > u").join(least, ["vault_id", "u"]).select("vault_id", F.col("v").alias("hi"), F.col("m").alias("lo"))
        )
        large = large.filter("hi <> lo").distinct()
        low = large.groupBy("vault_id", "hi").agg(F.min("lo").alias("m"))
        joined = large.join(low, ["vault_id", "hi"])
        small = joined.select("vault_id", F.col("lo").alias("hi"), F.col("m").alias("lo")).unionByName(
            joined.select("vault_id", "hi", F.col("m").alias("lo"))
        )
        pairs = cut_lineage(small.filter("hi <> lo").distinct())
    members = pairs.select("vault_id", F.col("hi").alias("node"), F.col("lo").alias("component"))
    roots = members.select("vault_id", F.col("component").alias("node"), "component").distinct()
    return members.unionByName(roots)


def _key_edges(ops: DataFrame) -> DataFrame:
    """Edges of renames and of idempotency keys that occur on more than one path."""
    renames = ops.filter(F.col("to_key").isNotNull()).select(
        "vault_id", F.col("path_key").alias("src"), F.col("to_key").alias("dst")
    )
    keyed = ops.filter(F.col("op_key").isNotNull())
    reused = keyed.groupBy("vault_id", "client_id", "op_key").agg(
        F.min("path_key").alias("a"), F.max("path_key").alias("b")
    )
    spread = reused.filter("a <> b").select(
        "vault_id", "client_id", "op_key", F.concat(F.lit("\u0000"), "client_id", F.lit("\u0000"), "op_key").alias("dst")
    )
    shared = keyed.join(spread, ["vault_id", "client_id", "op_key"]).select("vault_id", F.col("path_key").alias("src"), "dst")
    return renames.unionByName(shared).distinct()


def _log_stats(todo: DataFrame, labels: DataFrame | None, files: DataFrame | None, live_limit: int | None) -> DataFrame:
    """One row per vault: operations, largest component, and whether a live-file limit is
    within reach of this log's paths (``crowded``; such a vault folds as one component)."""
    # A path key adds one live file at most, and so does each target of its renames.
    grows = F.max(F.col("op").isin("put", "restore").cast("long")) + F.count_distinct("to_key")
    per_key = todo.groupBy("vault_id", "path_key").agg(
        F.count(F.lit(1)).alias("n"), (F.lit(0) if live_limit is None else grows).cast("long").alias("growth")
    )
    group = F.col("path_key")
    if labels is not None:
        per_key = per_key.join(labels.select("vault_id", F.col("node").alias("path_key"), "component"), ["vault_id", "path_key"], "left")
        group = F.coalesce("component", "path_key")
    parts = per_key.groupBy("vault_id", group.alias("component")).agg(F.sum("n").alias("n"), F.sum("growth").alias("growth"))
    vaults = parts.groupBy("vault_id").agg(F.sum("n").alias("ops"), F.max("n").alias("biggest"), F.sum("growth").alias("growth"))
    if live_limit is None:
        return vaults.withColumn("crowded", F.lit(False))
    if files is None:
        return vaults.withColumn("crowded", F.col("growth") >= live_limit)
    live = files.filter(~F.col("deleted")).groupBy("vault_id").agg(F.count(F.lit(1)).alias("live"))
    return vaults.join(live, "vault_id", "left").withColumn("crowded", F.col("growth") + F.coalesce("live", F.lit(0)) >= live_limit)


# ---- the fold -------------------------------------------------------------


class _Component:
    """State of one component: files by path, live paths by key, receipts of this log."""

    def __init__(self, live_limit):
        self.files, self.live, self.receipts, self.past = {}, {}, {}, {}
        self.live_limit = live_limit

    def load(self, row):
        self.files[row.path] = (row.rev, row.deleted, row.hash, row.size, row.kind, row.renamed_to, row.content)
        if not row.deleted:
            self.live[row.path_key] = row.path

    def blocked(self, op, expect, expected_rev, path, key):
        """First failing precondition as (reason, current row, existing path)."""
        cur = self.files.get(path)
        other = self.live.get(key)
        if expect == "match":
            if cur is None or cur[0] != expected_rev:
                return "precondition_failed", cur, None
            if op == "put" and cur[1] and other is not None:
                return "path_collision", None, other
        elif expect == "absent" and other is not None:
            return ("precondition_failed", cur, None) if other == path else ("path_collision", None, other)
        return None

    def plan(self, o):
        """(reason, existing) or the new rows [(path, key, deleted, hash, size, kind, renamed_to, content)]."""
        cur = self.files.get(o.path)
        if o.op == "put":
            return [(o.path, o.path_key, False, o.payload_hash, o.size, o.kind, None, o.content)]
        if o.op == "delete":
            kind = cur[4] if cur else o.kind
            return [(o.path, o.path_key, True, "", 0, kind, None, None)]
        if o.op == "append":
            if cur is None or cur[1]:
                return ("not_found" if cur is None else "tombstone"), None
            if cur[4] != "text" or cur[6] is None:
                return "unsupported_append_kind", None
            text = cur[6] + o.content if o.heading is None else insert_under(cur[6], o.heading, o.content)
            if text is None:
                return "heading_not_found", None
            raw = text.encode("utf-8")
            if len(raw) > K.INLINE_TEXT_LIMIT:
                return "text_too_large", None
            return [(o.path, o.path_key, False, hashlib.sha256(raw).hexdigest(), len(raw), "text", None, text)]
        if o.op == "restore":
            source = self.past.get((o.path, o.source_rev)) or (
                (o.source_deleted, o.source_hash, o.source_size, o.source_kind, o.source_content)
                if o.source_hash is not None else None
            )
            if source is None:
                return "revision_pruned", None
            if source[0]:
                return "invalid_request", None
            if cur is not None and not cur[1] and not o.as_conflict_copy:
                return "path_occupied", None
            other = self.live.get(o.path_key)
            if other not in (None, o.path):
                return "path_collision", other
            return [(o.path, o.path_key, False, source[1], source[2], source[3], None, source[4])]
        if o.op == "rename":
            if o.path == o.to_path:
                return "invalid_request", None
            if cur is None or cur[1]:
                return ("not_found" if cur is None else "tombstone"), None
            other = self.live.get(o.to_key)
            if other is not None and other != o.path:
                return "path_collision", other
            return [
                (o.path, o.path_key, True, "", 0, cur[4], o.to_path, None),
                (o.to_path, o.to_key, False, cur[2], cur[3], cur[4], None, cur[6]),
            ]
        return "invalid_request", None

    def step(self, o):
        base = {"vault_id": o.vault_id, "component": o.component, "arrival": o.arrival, "accepted": False, "live_delta": 0}
        if o.reason is not None:
            return base | {"reason": o.reason}
        if o.op_key is not None:
            earlier = self.receipts.get((o.client_id, o.op_key))
            if earlier is not None:
                if earlier[0] == o.fingerprint:
                    return base | {"reason": "replayed", "status": earlier[2], "replay_of": earlier[1]}
                return base | {"reason": "idempotency_mismatch"}
            if not o.key_ok:
                return base | {"reason": "operation_expired"}
        stop = self.blocked(o.op, o.expect, o.expected_rev, o.path, o.path_key)
        if stop is not None:
            reason, cur, existing = stop
            detail = dict(zip(("current_rev", "current_deleted", "current_hash"), cur)) if cur else {}
            if cur and cur[1]:
                detail["current_renamed_to"] = cur[5]
            return base | detail | {"reason": reason, "existing_path": existing}
        rows = self.plan(o)
        if isinstance(rows, tuple):
            return base | {"reason": rows[0], "existing_path": rows[1]}
        if self.live_limit is not None and o.op != "delete" and len(self.live) >= self.live_limit:
            return base | {"reason": "capacity_exceeded"}
        before, was_live = len(self.live), o.path in self.files and not self.files[o.path][1]
        revs = []
        for path, key, deleted, digest, size, kind, renamed_to, content in rows:
            rev = (self.files[path][0] if path in self.files else 0) + 1
            self.files[path] = (rev, deleted, digest, size, kind, renamed_to, content)
            if deleted and self.live.get(key) == path:
                del self.live[key]
            elif not deleted:
                self.live[key] = path
            if o.keep_past:
                self.past[(path, rev)] = (deleted, digest, size, kind, content)
            revs.append(rev)
        status = 201 if o.op == "rename" or not was_live else 200
        if o.op_key is not None:
            self.receipts[(o.client_id, o.op_key)] = (o.fingerprint, o.arrival, status)
        _, _, deleted, digest, size, kind, _, content = rows[-1]
        return base | {
            "accepted": True, "status": status, "rev": revs[-1], "from_rev": revs[0] if len(revs) > 1 else None,
            "hash": digest, "size": size, "kind": kind, "deleted": deleted, "live_delta": len(self.live) - before,
            "new_content": content if o.op in ("append", "restore", "rename") else None,
        }


def _fold(live_limit, columns, alike):
    """Streams sorted rows; a component's state lives only while its rows pass. Columns of ``alike`` have the value given
    there, or that of ``_more`` where a row brings one."""
    Row = namedtuple("Row", columns)

    def column(batch, name):
        if name not in alike:
            c = batch.column(name)
            return [None] * len(c) if c.null_count == len(c) else c.to_pylist()
        more = batch.column("_more")
        if more.null_count == len(more):
            return [alike[name]] * len(more)
        own = pc.struct_field(more, name).to_pylist()
        return [value if given else alike[name] for value, given in zip(own, more.is_valid().to_pylist())]

    def run(batches):
        owner = component = None
        for batch in batches:
            out = []
            values = (column(batch, name) for name in columns)
            for row in map(Row._make, zip(*values)):
                if (row.vault_id, row.component) != owner:
                    owner = (row.vault_id, row.component)
                    component = _Component(live_limit if row.counted else None)
                if row.role == 0:
                    component.load(row)
                elif row.role == 1:
                    component.receipts[(row.client_id, row.op_key)] = (row.fingerprint, row.arrival, row.status)
                elif row.role == 2:
                    component.past[(row.path, row.rev)] = (row.deleted, row.hash, row.size, row.kind, row.content)
                else:
                    out.append(component.step(row))
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_ARROW)

    return run


def well_formed() -> Column:
    """Each operation with the preconditions it may carry; only an append may come without one."""
    op, expect = F.col("op"), F.col("expect")
    allowed = (
        (op.isin("delete", "rename", "restore") & (expect == "match"))
        | ((op == "put") & expect.isin("absent", "match"))
        | ((op == "append") & expect.isin("none", "match"))
    )
    exact = (expect != "match") | (F.col("expected_rev") > 0)
    paths = F.col("path").isNotNull() & ((op == "rename") == F.col("to_path").isNotNull())
    return F.coalesce(allowed & exact & paths, F.lit(False))


def prepared(ops: DataFrame, now: Column | int | None) -> DataFrame:
    """The log with all optional columns, path keys, explicit preconditions and the answer of the key window at ``now``."""
    log = _with_defaults(ops, _DEFAULTS)
    return log.withColumns(
        {
            "path_key": path_key(F.col("path")),
            "to_key": path_key(F.col("to_path")) if "to_path" in ops.columns else F.lit(None).cast("string"),
            "expect": F.coalesce(
                "expect",
                F.when(F.col("expected_rev") > 0, "match")
                .when((F.col("op") == "put") & (F.col("expected_rev") == 0), "absent")
                .when((F.col("op") == "append") & F.col("expected_rev").isNull(), "none"),
            ),
            "kind": F.coalesce("kind", F.lit("text")),
            "key_ok": key_window(F.col("op_key"), now) if now is not None else F.lit(True),
            "replay_of": F.lit(None).cast("long"),
            "replay_status": F.lit(None).cast("int"),
        }
    )


def apply_ops(
    ops: DataFrame,
    files: DataFrame | None = None,
    receipts: DataFrame | None = None,
    revisions: DataFrame | None = None,
    *,
    claims: DataFrame | None = None,
    now_ms: int | None = None,
    live_limit: int | None = None,
    max_group_ops: int = 2_000_000,
) -> DataFrame:
    """One outcome row per operation.

    ``live_limit`` refuses what would pass that many live files per vault; it is off unless
    given, and then a vault that could reach it with this log's new paths folds in one order.

    ``ops``: vault_id, arrival (unique integer per vault), op, path and the columns of
    ``_DEFAULTS``; ``reason`` from :func:`authorize_ops` goes first. ``files`` is the state
    before the log, ``receipts`` and ``revisions`` what is retained. Only accepted keyed
    operations leave a receipt, so a failed one may be tried again under its key.
    """
    log = prepared(ops, now_ms)
    if receipts is not None:
        kept = receipts.select("vault_id", "client_id", "op_key", F.col("fingerprint").alias("_fp"),
                               F.col("status").alias("_status"), F.col("arrival").alias("_arrival"))
        found = F.col("_fp").isNotNull() & F.col("reason").isNull()
        same = F.col("_fp").eqNullSafe(F.col("fingerprint"))
        keyed = (
            log.filter(F.col("op_key").isNotNull()).join(kept, ["vault_id", "client_id", "op_key"], "left")
            .withColumn("replay_of", F.when(found & same, F.col("_arrival")))
            .withColumn("replay_status", F.when(found & same, F.col("_status")))
            .withColumn("reason", F.coalesce("reason", F.when(found, F.when(same, "replayed").otherwise("idempotency_mismatch"))))
            .drop("_fp", "_status", "_arrival")
        )
        # Operations without a key skip the lookup instead of meeting in one NULL join key.
        log = keyed.unionByName(log.filter(F.col("op_key").isNull()))
    if claims is not None:
        # A key that another request holds, without a receipt so far, can neither be replayed nor used.
        open_keys = claims.select("vault_id", "client_id", "op_key", F.lit(True).alias("_claimed")).distinct()
        keyed = log.filter(F.col("op_key").isNotNull()).join(open_keys, ["vault_id", "client_id", "op_key"], "left")
        keyed = keyed.withColumn("reason", F.coalesce("reason", F.when(F.col("_claimed"), "idempotency_in_progress"))).drop("_claimed")
        log = keyed.unionByName(log.filter(F.col("op_key").isNull()))
    decided = log.filter(F.col("reason").isNotNull()).select(
        "vault_id", F.lit(None).cast("string").alias("component"), "arrival", F.lit(False).alias("accepted"), "reason",
        F.col("replay_status").alias("status"), "replay_of",
        *[F.lit(0 if c == "live_delta" else None).cast(t).alias(c) for c, t in _FIELDS[7:]],
    )
    todo = log.filter(F.col("reason").isNull()).drop("replay_of", "replay_status")
    todo = todo.withColumn("reason", F.when(~well_formed(), "invalid_request"))
    linked = "to_path" in ops.columns or "op_key" in ops.columns
    outcomes = _run_components(todo, files, revisions, live_limit, max_group_ops, linked, ops.columns)
    if receipts is None and claims is None and "reason" not in ops.columns:
        return outcomes.drop("component")
    return outcomes.unionByName(decided).drop("component")


def _run_components(todo, files, revisions, live_limit, max_group_ops, linked, given):
    edges = _key_edges(todo.filter("reason IS NULL")) if linked else None
    labels = None if edges is None or edges.isEmpty() else cut_lineage(label_components(edges))
    stats = cut_lineage(_log_stats(todo, labels, files, live_limit))  # one row per vault
    biggest = stats.agg(F.max(F.when(F.col("crowded"), F.col("ops")).otherwise(F.col("biggest")))).first()[0] or 0
    crowded = stats.filter("crowded").select("vault_id", F.lit(True).alias("counted"))
    none_crowded = crowded.isEmpty()

    def place(df, key):
        """Attach component and the capacity flag by path key."""
        if none_crowded:
            placed = df.withColumn("counted", F.lit(False))
        else:
            placed = df.join(crowded, "vault_id", "left").withColumn("counted", F.coalesce("counted", F.lit(False)))
        own = F.col(key)
        if labels is not None:
            placed = placed.join(
                labels.select("vault_id", F.col("node").alias(key), "component"), ["vault_id", key], "left"
            )
            own = F.coalesce("component", key)
        return placed.withColumn("component", F.when(F.col("counted"), F.lit("")).otherwise(own))

    placed = place(todo, "path_key")
    text_groups = placed.filter(F.col("op").isin("append", "rename")).select("vault_id", "component", F.lit(True).alias("_text")).distinct()
    past_groups = placed.filter(F.col("op") == "restore").select("vault_id", "component", F.lit(True).alias("_past")).distinct()
    flags = text_groups.join(past_groups, ["vault_id", "component"], "full_outer")
    # Text travels only where an append, rename or restore of this component needs it.
    placed = (
        placed.join(flags, ["vault_id", "component"], "left")
        .withColumn("keep_past", F.coalesce("_past", F.lit(False)))
        .withColumn("content", F.when(F.coalesce("_text", "_past", F.lit(False)) | (F.col("op") == "append"), F.col("content")))
        .drop("_text", "_past")
    )
    if revisions is not None:
        old = revisions.select(
            "vault_id", "path", F.col("rev").alias("source_rev"), F.col("hash").alias("source_hash"),
            F.col("size").alias("source_size"), F.col("kind").alias("source_kind"),
            F.col("deleted").alias("source_deleted"), F.col("content").alias("source_content"),
        )
        placed = placed.join(old, ["vault_id", "path", "source_rev"], "left")
    else:
        placed = placed.withColumns({f"source_{c}": F.lit(None).cast(t) for c, t in
                                     (("hash", "string"), ("size", "long"), ("kind", "string"), ("deleted", "boolean"), ("content", "string"))})
    narrow = placed.select(
        "vault_id", "component", "counted", F.lit(3).alias("role"), "arrival", "op", "path", "path_key", "to_path", "to_key",
        "client_id", "op_key", "fingerprint", "key_ok", "expect", "expected_rev", "kind", "size", "payload_hash", "content",
        "heading", "source_rev", "as_conflict_copy", "keep_past", "source_hash", "source_size", "source_kind",
        "source_deleted", "source_content", "reason",
        *[F.lit(None).cast(t).alias(c) for c, t in
          (("rev", "long"), ("deleted", "boolean"), ("hash", "string"), ("renamed_to", "string"), ("status", "int"))],
    )
    alike = _alike(given, revisions)
    touched = placed.select("vault_id", "component").distinct()
    start = None if files is None else _state_rows(files, place, touched, narrow)

    if biggest <= max_group_ops:
        return _fold_once(narrow, start, live_limit, alike)

    ranked = cut_lineage(
        arrival_rank(narrow.drop(*alike), ["vault_id", "component"], "arrival", "_rank", max_group_ops)
        .withColumn("_part", F.floor((F.col("_rank") - 1) / F.lit(max_group_ops)))
    ).withColumns({c: F.lit(value).cast(narrow.schema[c].dataType) for c, value in alike.items()})
    done = None
    for part in range(-(-biggest // max_group_ops)):
        rows = ranked.filter(F.col("_part") == part).select(narrow.columns)
        carried = start if done is None else _carry(done, ranked, start, rows)
        result = cut_lineage(_fold_once(rows, carried, live_limit, alike))
        done = result if done is None else done.unionByName(result)
    return done


def _shape(df, like):
    """Rows of state in the column layout of the log."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast(like.schema[c].dataType).alias(c) for c in like.columns])


def _state_rows(files, place, touched, like):
    state = _with_defaults(files, _STATE).withColumn("path_key", path_key(F.col("path")))
    state = place(state, "path_key").join(touched, ["vault_id", "component"], "left_semi")
    return _shape(state.withColumns({"role": F.lit(0), "arrival": F.lit(-1).cast("long")}), like)


def _carry(done, ranked, start, rows):
    """State after the finished slices: newest row per path, receipts, and revisions for restores."""
    wanted = rows.select("vault_id", "component").distinct()
    facts = done.filter("accepted").join(
        ranked.drop("hash", "size", "kind", "deleted", "rev", "status", "reason"), ["vault_id", "component", "arrival"]
    ).join(wanted, ["vault_id", "component"], "left_semi")
    text = F.when(~F.col("deleted"), F.coalesce("new_content", "content"))
    landed = facts.withColumns(
        {
            "content": text,
            "path": F.coalesce("to_path", "path"),
            "path_key": F.coalesce("to_key", "path_key"),
            "renamed_to": F.lit(None).cast("string"),
        }
    )
    vacated = facts.filter("op = 'rename'").withColumns(
        {
            "rev": F.col("from_rev"), "deleted": F.lit(True), "hash": F.lit(""), "size": F.lit(0).cast("long"),
            "content": F.lit(None).cast("string"), "renamed_to": F.col("to_path"),
        }
    )
    written = landed.unionByName(vacated)
    before = [] if start is None else [start]
    latest = _shape(written, rows).withColumn("role", F.lit(0))
    for extra in before:
        latest = latest.unionByName(extra)
    newest = Window.partitionBy("vault_id", "path").orderBy(F.col("rev").desc())
    state = latest.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n")
    state = state.withColumn("arrival", F.lit(-1).cast("long"))
    keys = _shape(facts.filter(F.col("op_key").isNotNull()), rows).withColumn("role", F.lit(1))
    past = _shape(written.filter("keep_past"), rows).withColumn("role", F.lit(2))
    return state.unionByName(keys).unionByName(past)


def _alike(given: list[str], revisions: DataFrame | None) -> dict:
    """Columns that hold one value in every row of the log, as it does not bring them."""
    none = [c for c in ("to_path", "client_id", "op_key", "fingerprint", "expected_rev", "size", "payload_hash", "heading", "source_rev", "as_conflict_copy") if c not in given]
    if "to_path" not in given:
        none.append("to_key")
    if revisions is None:
        none += ["source_hash", "source_size", "source_kind", "source_deleted", "source_content"]
    if "content" not in given:
        none.append("content")
    alike = dict.fromkeys([*none, "rev", "deleted", "hash", "renamed_to", "status"])
    return alike | ({} if "kind" in given else {"kind": "text"})


def _fold_once(rows: DataFrame, state: DataFrame | None, live_limit: int | None, alike: dict) -> DataFrame:
    """Outcomes of ``rows`` after ``state``. What is alike in all rows of the log is neither shuffled nor sorted; rows of state bring it in ``_more``."""
    more = F.struct(*alike)
    slim = [c for c in rows.columns if c not in alike]
    everything = rows.select(*slim, F.lit(None).cast(rows.select(more).schema[0].dataType).alias("_more"))
    if state is not None:
        everything = everything.unionByName(state.select(*slim, more.alias("_more")))
    # A fixed partition count: the fold is CPU work, so small inputs must not be coalesced to one task.
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The partitioning key is an expression of its own: a planner that believes the union already
    # keeps its inputs' partitioning could otherwise leave the exchange out.
    return (
        everything.repartition(tasks, F.xxhash64("vault_id", "component"))
        .sortWithinPartitions("vault_id", "component", "role", "arrival")
        .mapInArrow(_fold(live_limit, rows.columns, alike), OUTCOME)
    )


# ---- what an accepted log writes -------------------------------------------


def assign_seq(outcomes: DataFrame, head: DataFrame | None = None) -> DataFrame:
    """Gap-free ``seq`` per vault over accepted rows in arrival order, after ``head.head_seq``."""
    # Ranking reads its input twice; written down once, the fold is not run again for it.
    ranked = arrival_rank(cut_lineage(outcomes.filter("accepted")), ["vault_id"], "arrival", "seq")
    if head is None:
        return ranked
    return (
        ranked.join(head.select("vault_id", "head_seq"), "vault_id", "left")
        .withColumn("seq", F.col("seq") + F.coalesce("head_seq", F.lit(0)))
        .drop("head_seq")
    )


def written_rows(accepted: DataFrame, ops: DataFrame) -> DataFrame:
    """Revision rows of accepted operations: one per path written, two for a rename."""
    log = _with_defaults(ops, _DEFAULTS).select(
        "vault_id", "arrival", "op", "path", "to_path", "client_id", "at_ms", F.col("content").alias("_content")
    )
    facts = accepted.join(log, ["vault_id", "arrival"])
    text = F.when(~F.col("deleted") & (F.col("kind") == "text"), F.coalesce("new_content", "_content"))
    common = ["vault_id", "arrival", "seq"] if "seq" in accepted.columns else ["vault_id", "arrival"]
    target = facts.select(
        *common, F.coalesce("to_path", "path").alias("path"), "rev", "hash", "size", "kind", text.alias("content"),
        F.when(F.col("kind") == "blob", F.col("hash")).alias("blob_hash"), "deleted",
        F.lit(None).cast("string").alias("renamed_to"), F.col("client_id").alias("origin"), "at_ms",
    )
    source = facts.filter("op = 'rename'").select(
        *common, "path", F.col("from_rev").alias("rev"), F.lit("").alias("hash"), F.lit(0).cast("long").alias("size"),
        "kind", F.lit(None).cast("string").alias("content"), F.lit(None).cast("string").alias("blob_hash"),
        F.lit(True).alias("deleted"), F.col("to_path").alias("renamed_to"), F.col("client_id").alias("origin"), "at_ms",
    )
    return target.unionByName(source)


def feed_rows(sequenced: DataFrame, ops: DataFrame) -> DataFrame:
    """Change-feed rows: one per accepted operation; a rename carries both sides."""
    log = _with_defaults(ops, _DEFAULTS).select("vault_id", "arrival", "op", "path", "to_path", "client_id", "at_ms")
    shown = F.when(F.col("op").isin("delete", "rename"), F.col("op")).otherwise("put")
    return sequenced.join(log, ["vault_id", "arrival"]).select(
        "vault_id", "seq", shown.alias("op"), F.coalesce("to_path", "path").alias("path"), "rev", "hash",
        F.when(F.col("op") == "rename", F.col("path")).alias("from_path"), "from_rev",
        F.col("client_id").alias("origin"), "at_ms",
    )


def receipt_rows(accepted: DataFrame, ops: DataFrame, epoch: str) -> DataFrame:
    """Receipts of accepted keyed operations."""
    log = _with_defaults(ops, _DEFAULTS).select("vault_id", "arrival", "client_id", "op_key", "fingerprint", "at_ms")
    return (
        accepted.join(log.filter(F.col("op_key").isNotNull()), ["vault_id", "arrival"])
        .select("vault_id", "client_id", "op_key", "fingerprint", "status", "arrival",
                format_etag(F.lit(epoch), F.col("rev")).alias("etag"), "at_ms")
    )


def dedupe_ops(ops: DataFrame, receipts: DataFrame | None = None, claims: DataFrame | None = None) -> DataFrame:
    """Idempotency by (client, key) where every first use counts: ``new``, ``replayed``,
    ``idempotency_mismatch``, and ``idempotency_in_progress`` for a key in ``claims`` (vault_id,
    client_id, op_key) that has no stored receipt yet. The first use is found by an aggregate
    with map-side combine and joined back, so a hot key needs no window of its own."""
    keyed = ops.filter(F.col("op_key").isNotNull())
    first = keyed.groupBy("vault_id", "client_id", "op_key").agg(
        F.min_by(F.struct("arrival", "fingerprint"), "arrival").alias("_first")
    )
    seen = first.select("vault_id", "client_id", "op_key", F.col("_first.arrival").alias("first_arrival"),
                        F.col("_first.fingerprint").alias("_fp"))
    if receipts is not None:
        stored = receipts.select("vault_id", "client_id", "op_key", F.col("arrival").alias("_old"), F.col("fingerprint").alias("_old_fp"))
        seen = seen.join(stored, ["vault_id", "client_id", "op_key"], "left").select(
            "vault_id", "client_id", "op_key", F.coalesce("_old", "first_arrival").alias("first_arrival"),
            F.coalesce("_old_fp", "_fp").alias("_fp"), F.col("_old").isNotNull().alias("_stored"),
        )
    if claims is not None:
        open_keys = claims.select("vault_id", "client_id", "op_key", F.lit(True).alias("_claimed")).distinct()
        if receipts is not None:
            open_keys = open_keys.join(receipts.select("vault_id", "client_id", "op_key"), ["vault_id", "client_id", "op_key"], "left_anti")
        seen = seen.join(open_keys, ["vault_id", "client_id", "op_key"], "left")
    judged = keyed.join(seen, ["vault_id", "client_id", "op_key"]).withColumn(
        "outcome",
        F.when(F.col("_claimed") if claims is not None else F.lit(False), "idempotency_in_progress")
        .when((F.col("arrival") == F.col("first_arrival")) & ~(F.col("_stored") if receipts is not None else F.lit(False)), "new")
        .when(F.col("_fp") == F.col("fingerprint"), "replayed").otherwise("idempotency_mismatch"),
    )
    free = ops.filter(F.col("op_key").isNull()).withColumns({"first_arrival": F.lit(None).cast("long"), "outcome": F.lit("new")})
    return judged.drop("_fp", "_stored", "_claimed").unionByName(free)
