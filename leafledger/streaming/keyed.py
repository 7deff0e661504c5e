"""Conditional apply as a stateful stream: state by key in the state store, not in files that each batch reads again.

Operations are grouped by ``(vault_id, scope)`` and go, in arrival order, through the same steps as in a batch. What
the steps look at lies in maps of the state store and is read entry by entry: files by path, live paths by path key, receipts by
(client, key) for as long as a key may be used again, revisions by (path, rev) for as long as they may be restored. So a
micro-batch reads its own rows and the entries they name, however long the history. Receipts and revisions leave by their time to
live; nothing has to be pruned.

The scope is the vault unless the caller names a finer one, such as the path key or the top folder, for logs in which no
rename and no reused key leaves it; an operation whose two paths lie in two scopes is refused as ``invalid_request``. A
scope is one task of a micro-batch, and its rows of that batch are sorted there, so ``maxFilesPerTrigger`` bounds them.

The sink writes one folder per batch. Sequence numbers follow from the head of each vault, a row per vault
written beside each batch; earlier outcomes, revisions and changes are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from .. import constants as K
from ..functions.unicode import path_key
from ..operators import apply as A
from ..operators.apply import _Component
from ..operators.policy import authorize_ops
from ..session import cut_lineage
from .store import read_before, write_batch

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_FILE = "rev long, deleted boolean, hash string, size long, kind string, renamed_to string, content string"
_REVISION = "deleted boolean, hash string, size long, kind string, content string"
_RECEIPT = "fingerprint string, arrival long, status int"
# Columns of the log that the sink needs beside the outcome.
_FACTS = "op string, path string, to_path string, client_id string, op_key string, fingerprint string, content string, at_ms long"
_OUTCOME = [(n, t) for n, t in (part.split() for part in A.OUTCOME.split(", ")) if n != "component"]
RESULT = ", ".join(f"{n} {t}" for n, t in _OUTCOME) + ", " + _FACTS
_RESULT_NAMES = [part.split()[0] for part in RESULT.split(", ")]
_FACT_NAMES = [part.split()[0] for part in _FACTS.split(", ")]


class _Map:
    """A map of the state store as the fold sees it: read once per entry, changes written back together."""

    def __init__(self, state, single: bool = False):
        self.state, self.single, self.held, self.changed = state, single, {}, {}

    def _key(self, key):
        return key if isinstance(key, tuple) else (key,)

    def get(self, key):
        if key not in self.held:
            own = self._key(key)
            found = tuple(self.state.getValue(own)) if self.state.containsKey(own) else None
            self.held[key] = found[0] if found and self.single else found
        return self.held[key]

    def __contains__(self, key):
        return self.get(key) is not None

    def __getitem__(self, key):
        return self.get(key)

    def __setitem__(self, key, value):
        self.held[key] = self.changed[key] = value

    def __delitem__(self, key):
        self.held[key] = self.changed[key] = None

    def flush(self):
        for key, value in self.changed.items():
            if value is None:
                self.state.removeKey(self._key(key))
            else:
                self.state.updateValue(self._key(key), (value,) if self.single else tuple(value))


class _Live(_Map):
    """Live paths by path key; their number is kept beside them."""

    def __init__(self, state, count):
        super().__init__(state, single=True)
        self.count, self.size = count, (count.get() or (0,))[0] if count.exists() else 0

    def __len__(self):
        return self.size

    def __setitem__(self, key, value):
        self.size += self.get(key) is None
        super().__setitem__(key, value)

    def __delitem__(self, key):
        self.size -= self.get(key) is not None
        super().__delitem__(key)

    def flush(self):
        super().flush()
        if self.changed:
            self.count.update((self.size,))


class ApplyProcessor(StatefulProcessor):
    """The steps of the conditional apply over one scope's state."""

    def __init__(self, live_limit: int | None, receipt_ms: int, revision_ms: int):
        self.live_limit, self.receipt_ms, self.revision_ms = live_limit, receipt_ms, revision_ms

    def init(self, handle):
        self.files = handle.getMapState("files", "path string", _FILE)
        self.live = handle.getMapState("live", "path_key string", "path string")
        self.count = handle.getValueState("count", "live long")
        self.receipts = handle.getMapState("receipts", "client_id string, op_key string", _RECEIPT, self.receipt_ms)
        self.past = handle.getMapState("past", "path string, rev long", _REVISION, self.revision_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        component = _Component(self.live_limit)
        maps = component.files, component.live, component.receipts, component.past = (
            _Map(self.files), _Live(self.live, self.count), _Map(self.receipts), _Map(self.past)
        )
        for row in sorted(rows, key=lambda r: r.arrival):
            out = {n: row[n] for n in _FACT_NAMES} | component.step(row)
            yield Row(**{n: out.get(n) for n in _RESULT_NAMES})
        for each in maps:
            each.flush()

    def close(self):
        pass


def apply_keyed(
    ops: DataFrame, scope: Column | None = None, *, now: Column | None = None, live_limit: int | None = None,
    vault_state: DataFrame | None = None, revoked: DataFrame | None = None,
    receipt_ms: int = K.KEY_PAST_MS, revision_ms: int = K.RETENTION_DAYS * K.DAY_MS,
) -> DataFrame:
    """Stream of outcomes with the facts of their operations, for a stream ``ops`` as :func:`apply_ops` takes it.

    With ``vault_state`` and ``revoked`` (tables), operations are authorized first, against the tables as of each batch. ``scope`` is a
    column over ``path``; for a rename it is also taken of the target. ``live_limit`` counts within a scope.
    """
    if vault_state is not None:
        ops = authorize_ops(ops, vault_state, revoked)
    log = A.prepared(ops, now)
    if scope is None:
        placed = log.withColumn("scope", F.lit(""))
        same = F.lit(True)
    else:
        placed = log.withColumn("scope", scope)
        there = log.withColumn("path", F.coalesce("to_path", "path")).select(scope.alias("t")).schema["t"]
        other = placed.withColumns({"_path": F.col("path"), "path": F.coalesce("to_path", "path")}).withColumn("_there", scope.cast(there.dataType))
        placed = other.withColumn("path", F.col("_path")).drop("_path")
        same = F.col("_there").eqNullSafe(F.col("scope"))
    # A malformed operation, also one without a path, is refused by its reason and touches no state.
    checked = placed.withColumn("reason", F.coalesce("reason", F.when(~(A.well_formed() & same), "invalid_request"))).drop("_there")
    rows = checked.select(
        "vault_id", F.coalesce(F.col("scope").cast("string"), F.lit("")).alias("scope"), F.lit(None).cast("string").alias("component"), "arrival", "reason", "op",
        "path", "path_key", "to_path", "to_key", "client_id", "op_key", "fingerprint", "key_ok", "expect", "expected_rev", "kind", "size", "payload_hash",
        "content", "heading", "source_rev", "as_conflict_copy", "at_ms", F.lit(True).alias("keep_past"),
        *[F.lit(None).cast(t).alias(f"source_{c}") for c, t in (("hash", "string"), ("size", "long"), ("kind", "string"), ("deleted", "boolean"), ("content", "string"))],
    )
    processor = ApplyProcessor(live_limit, receipt_ms, revision_ms)
    return rows.groupBy("vault_id", "scope").transformWithState(processor, RESULT, "Append", "ProcessingTime")


def by_path() -> Column:
    """The finest scope: one path, whatever its case."""
    return path_key(F.col("path"))


def keyed_batch(batch: DataFrame, root: str, heads_root: str, batch_id: int, epoch: str) -> None:
    """Write one micro-batch of outcomes as ``outcomes``, ``revisions``, ``changes``, ``receipts`` and ``heads``."""
    spark = batch.sparkSession
    rows = cut_lineage(batch)
    ops = rows.select("vault_id", "arrival", *_FACT_NAMES)
    outcomes = rows.select(*[n for n, _ in _OUTCOME])
    before = read_before(spark, heads_root, "heads", batch_id)
    head = None
    if before is not None:
        last = before.agg(F.max("batch")).first()[0]
        head = before.filter(F.col("batch") == last).select("vault_id", "head_seq")
    sequenced = cut_lineage(A.assign_seq(outcomes, head))
    write_batch(outcomes, root, "outcomes", batch_id)
    write_batch(A.written_rows(sequenced, ops).drop("renamed_to", "seq", "arrival"), root, "revisions", batch_id)
    write_batch(A.feed_rows(sequenced, ops), root, "changes", batch_id)
    write_batch(A.receipt_rows(sequenced, ops, epoch), root, "receipts", batch_id)
    heads = sequenced.select("vault_id", F.col("seq").alias("head_seq"))
    if head is not None:
        heads = heads.unionByName(head)
    write_batch(heads.groupBy("vault_id").agg(F.max("head_seq").alias("head_seq")), heads_root, "heads", batch_id)


# Fixed for the query when it starts: the store that can expire entries, and no batches without data. A stage with entries to
# expire asks for another batch for ever, so an ``availableNow`` run would never end; entries expire with the next data.
_SETTINGS = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}


def start_keyed(outcomes: DataFrame, root: str, checkpoint: str, epoch: str, heads_root: str | None = None, **trigger) -> StreamingQuery:
    """Start the sink of :func:`apply_keyed`. A batch run again after a failure overwrites its own folders with the same rows."""

    def run(batch: DataFrame, batch_id: int) -> None:
        keyed_batch(batch, root, heads_root or root, batch_id, epoch)

    conf = outcomes.sparkSession.conf
    before = {name: conf.get(name, None) for name in _SETTINGS}
    writer = outcomes.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).outputMode("append")
    try:
        for name, value in _SETTINGS.items():
            conf.set(name, value)
        return (writer.trigger(**trigger) if trigger else writer).start()
    finally:
        for name, value in before.items():
            conf.unset(name) if value is None else conf.set(name, value)
