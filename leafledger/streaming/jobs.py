"""The streaming jobs: conditional apply, metrics, index maintenance, debounce."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.window import Window

from .. import constants as K
from ..functions.identity import utc_day
from ..operators import apply as A
from ..operators import search as S
from ..session import cut_lineage, neighbour
from .store import newest, read_before, read_state, write_batch
from .tiers import FAN, add_run, read_index

# ---- conditional apply -------------------------------------------------------


def apply_stream(ops: DataFrame, root: str, checkpoint: str, epoch: str, **limits) -> DataStreamWriter:
    """Applies each micro-batch of operations to the state left by the earlier ones.

    Writes ``outcomes``, ``revisions``, ``changes``, ``receipts`` and ``files`` (changed
    rows only) per batch; a scheduled :func:`~leafledger.streaming.store.compact` of
    ``files`` keeps the state short. State of untouched paths is filtered out by a semi-join before
    the fold; only narrow columns of it are read.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        apply_batch(batch, root, batch_id, epoch, **limits)

    return ops.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)


def apply_batch(batch: DataFrame, root: str, batch_id: int, epoch: str, **limits) -> None:
    spark = batch.sparkSession
    files = read_state(spark, root, "files", batch_id)
    state = None if files is None else newest(files, ["vault_id", "path"])
    receipts = read_before(spark, root, "receipts", batch_id)
    revisions = read_before(spark, root, "revisions", batch_id)
    changes = read_before(spark, root, "changes", batch_id)
    head = None if changes is None else changes.groupBy("vault_id").agg(F.max("seq").alias("head_seq"))
    outcomes = cut_lineage(A.apply_ops(batch, state, receipts, revisions, **limits))
    sequenced = cut_lineage(A.assign_seq(outcomes, head))
    written = A.written_rows(sequenced, batch)
    write_batch(outcomes, root, "outcomes", batch_id)
    write_batch(written.drop("renamed_to", "seq", "arrival"), root, "revisions", batch_id)
    write_batch(A.feed_rows(sequenced, batch), root, "changes", batch_id)
    write_batch(A.receipt_rows(sequenced, batch, epoch), root, "receipts", batch_id)
    last = written.groupBy("vault_id", "path").agg(
        F.max_by(F.struct("rev", "seq", "hash", "size", "kind", "content", "blob_hash", "renamed_to", "deleted", "origin", "at_ms"), "rev").alias("s")
    )
    write_batch(last.select("vault_id", "path", "s.*").withColumnRenamed("at_ms", "updated_at"), root, "files", batch_id)


# ---- metrics -----------------------------------------------------------------

_CLIENT = ["vault_id", "day_start", "client_id"]


def metrics_stream(observations: DataFrame, root: str, checkpoint: str) -> DataStreamWriter:
    """Daily metrics with late rules. Each batch is reduced to one row per (day, client) and
    merged into the stored rows, so no vault's raw rows gather in one task."""

    def run(batch: DataFrame, batch_id: int) -> None:
        metrics_batch(batch, root, batch_id)

    return observations.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)


def metrics_batch(batch: DataFrame, root: str, batch_id: int) -> None:
    from ..operators.metrics import drop_late

    spark = batch.sparkSession
    before = read_state(spark, root, "clients", batch_id)
    old = None if before is None else newest(before, _CLIENT)
    rows = batch
    if old is not None:
        # Days behind the vault's current one stay closed across batches.
        current = old.groupBy("vault_id").agg(F.max("day_start").alias("current_day"))
        rows = rows.join(current, "vault_id", "left").filter(
            F.col("current_day").isNull() | (utc_day(F.col("observed_at")) >= F.col("current_day"))
        ).drop("current_day")
    kept = cut_lineage(drop_late(rows))
    fresh = client_partials(kept)
    merged = fresh if old is None else merge_partials(old.join(fresh.select(*_CLIENT), _CLIENT, "left_semi"), fresh)
    write_batch(merged, root, "clients", batch_id)
    samples = kept.filter("feed_request").groupBy("vault_id", "day_start", "duration_ms").agg(
        F.count(F.lit(1)).alias("n"), F.min("observed_at").alias("first_at"), F.max("observed_at").alias("last_at")
    )
    write_batch(samples, root, "samples", batch_id)


def client_partials(kept: DataFrame) -> DataFrame:
    """Mergeable row per (day, client): counts, first and last feed request, intervals, poison."""
    counts = kept.groupBy(*_CLIENT).agg(
        F.min("arrival").alias("first_arrival"), F.count_if(F.col("protocol") == "rest").alias("requests_rest"),
        F.count_if(F.col("protocol") == "mcp").alias("requests_mcp"), F.min("observed_at").alias("observed_from"),
        F.max("observed_at").alias("observed_through"),
    )
    feed = kept.filter("feed_request").select(*_CLIENT, "arrival", "observed_at")
    gap = F.col("observed_at") - F.col("previous")
    cadence = neighbour(feed, _CLIENT, "arrival", F.col("observed_at"), "previous", forward=False).groupBy(*_CLIENT).agg(
        F.min_by("observed_at", "arrival").alias("first_feed"), F.max("observed_at").alias("last_feed"),
        F.min(gap).alias("lo"), F.max(gap).alias("hi"), F.max(F.coalesce(gap < 0, F.lit(False))).alias("poisoned"),
        F.min("observed_at").alias("least_feed"),
    )
    return counts.join(cadence, _CLIENT, "left").withColumn("poisoned", F.coalesce("poisoned", F.lit(False)))


def merge_partials(old: DataFrame, fresh: DataFrame) -> DataFrame:
    """Rows of the new batch merged after the stored ones (``old`` precedes ``fresh``)."""
    o, n = old.alias("o"), fresh.alias("n")
    joined = n.join(o, [F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}")) for k in _CLIENT], "left")
    step = F.col("n.first_feed") - F.col("o.last_feed")

    def both(fn, column):
        return fn(F.coalesce(f"o.{column}", f"n.{column}"), F.coalesce(f"n.{column}", f"o.{column}")).alias(column)

    low = F.array_min(F.array_compact(F.array("o.lo", "n.lo", step)))
    high = F.array_max(F.array_compact(F.array("o.hi", "n.hi", step)))
    late = F.coalesce(F.col("n.least_feed") < F.col("o.last_feed"), F.lit(False))
    return joined.select(
        *[F.col(f"n.{k}").alias(k) for k in _CLIENT], both(F.least, "first_arrival"),
        *[(F.col(f"n.{c}") + F.coalesce(F.col(f"o.{c}"), F.lit(0))).alias(c) for c in ("requests_rest", "requests_mcp")],
        both(F.least, "observed_from"), both(F.greatest, "observed_through"),
        F.coalesce("o.first_feed", "n.first_feed").alias("first_feed"), both(F.greatest, "last_feed"), low.alias("lo"), high.alias("hi"),
        (F.coalesce("o.poisoned", F.lit(False)) | F.col("n.poisoned") | late).alias("poisoned"), both(F.least, "least_feed"),
    )


def read_daily(spark: SparkSession, root: str, limit: int = K.MAX_DAILY_CLIENTS) -> DataFrame:
    """Day totals over the stored clients; more than ``limit`` of them make coverage incomplete."""
    clients = newest(read_state(spark, root, "clients", 2**62), _CLIENT)
    return clients.groupBy("vault_id", "day_start").agg(
        F.sum("requests_rest").alias("requests_rest"), F.sum("requests_mcp").alias("requests_mcp"), F.min("observed_from").alias("request_observed_from"),
        F.max("observed_through").alias("request_observed_through"), (F.count(F.lit(1)) > limit).alias("coverage_incomplete"),
    )


def read_p95(spark: SparkSession, root: str, share: float = 0.95) -> DataFrame:
    """Nearest-rank p95 of a day over the durations counted in all batches."""
    day = ["vault_id", "day_start"]
    counts = read_before(spark, root, "samples", 2**62).groupBy(*day, "duration_ms").agg(
        F.sum("n").alias("n"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at")
    )
    total = counts.groupBy(*day).agg(F.sum("n").alias("sample_count"), F.min("first_at").alias("first_sample_at"), F.max("last_at").alias("last_sample_at"))
    reached = F.sum("n").over(Window.partitionBy(*day).orderBy("duration_ms").rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.select(*day, "duration_ms", reached.alias("reached")).join(total, day)
    return ranked.filter(F.col("reached") >= F.ceil(F.lit(share) * F.col("sample_count"))).groupBy(*day).agg(
        F.min("duration_ms").alias("p95"), F.first("sample_count").alias("sample_count"), F.first("first_sample_at").alias("first_sample_at"),
        F.first("last_sample_at").alias("last_sample_at"),
    )


def read_metrics(spark: SparkSession, root: str) -> DataFrame:
    """Client rows of the daily metrics as of the last finished batch."""
    rows = newest(read_state(spark, root, "clients", 2**62), _CLIENT)
    order = Window.partitionBy("vault_id", "day_start").orderBy("first_arrival")
    ranked = rows.withColumn("client_no", F.row_number().over(order))
    return ranked.select(
        *_CLIENT, "client_no", "requests_rest", "requests_mcp", F.col("last_feed").alias("last_feed_request_at"),
        F.col("poisoned").alias("poll_cadence_incomplete"), F.when(~F.col("poisoned"), F.col("lo")).alias("minimum_poll_interval_ms"),
        F.when(~F.col("poisoned"), F.col("hi")).alias("maximum_poll_interval_ms"),
    )


# ---- search index --------------------------------------------------------------


def postings_stream(changed: DataFrame, root: str, checkpoint: str, fan: int = FAN) -> DataStreamWriter:
    """Keeps a tiered index of postings current: per batch, new postings of changed paths and the paths themselves.

    ``changed`` carries the new current row of each path (columns of ``files``)."""

    def run(batch: DataFrame, batch_id: int) -> None:
        last = batch.groupBy("vault_id", "path").agg(F.max_by(F.struct(*[c for c in batch.columns if c not in ("vault_id", "path")]), "rev").alias("s"))
        rows = cut_lineage(last.select("vault_id", "path", "s.*"))
        add_run(root, batch_id, S.build_postings(S.indexed_notes(rows)), rows.select("vault_id", "path"), fan)

    return changed.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)


def read_postings(spark: SparkSession, root: str) -> DataFrame:
    """Postings in force: those of the last batch that touched their path."""
    return read_index(spark, root)


# ---- debounce -------------------------------------------------------------------


def debounce_stream(events: DataFrame, gap: str = "2 seconds", late: str = "10 seconds") -> DataFrame:
    """One flush per device and quiet period, by session windows over event time.

    ``events`` is a stream with ``at_ms``. Sessions are merged inside each task first
    (``spark.sql.sessionWindow.merge.sessions.in.local.partition``)."""
    events.sparkSession.conf.set("spark.sql.sessionWindow.merge.sessions.in.local.partition", "true")
    timed = events.withColumn("ts", F.timestamp_millis("at_ms")).withWatermark("ts", late)
    return timed.groupBy("device_id", "vault_id", F.session_window("ts", gap).alias("w")).agg(
        F.count(F.lit(1)).alias("events"), F.min("at_ms").alias("first_at"), F.max("at_ms").alias("last_at")
    ).select("device_id", "vault_id", "first_at", "last_at", "events", F.unix_millis("w.end").alias("flush_at"))


def debounce_events(events: DataFrame, gap_ms: int = 2_000) -> DataFrame:
    """Batch form. A burst starts and ends where the neighbouring event is ``gap_ms`` or more
    away; the k-th start belongs to the k-th end. Every step works in arrival ranges."""
    keys = ["device_id", "vault_id"]
    rows = A.arrival_rank(events.select(*keys, "arrival", "at_ms"), keys, "arrival", "position")
    back = neighbour(rows, keys, "arrival", F.col("at_ms"), "before", forward=False)
    both = neighbour(back, keys, "arrival", F.col("at_ms"), "after", forward=True)
    first = F.coalesce(F.col("at_ms") - F.col("before") >= gap_ms, F.lit(True))
    last = F.coalesce(F.col("after") - F.col("at_ms") >= gap_ms, F.lit(True))
    starts = A.arrival_rank(both.filter(first), keys, "arrival", "burst").select(*keys, "burst", F.col("at_ms").alias("first_at"), F.col("position").alias("p1"))
    ends = A.arrival_rank(both.filter(last), keys, "arrival", "burst").select(*keys, "burst", F.col("at_ms").alias("last_at"), F.col("position").alias("p2"))
    return starts.join(ends, [*keys, "burst"]).select(
        *keys, "first_at", "last_at", (F.col("p2") - F.col("p1") + 1).alias("events"), (F.col("last_at") + gap_ms).alias("flush_at")
    )
