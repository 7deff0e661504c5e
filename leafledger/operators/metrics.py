"""Daily service metrics with explicit late-data rules, and the admission load report.

Observations carry vault_id, client_id, protocol (rest/mcp), feed_request, observed_at,
duration_ms and arrival (unique integer in arrival order).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import constants as K
from ..functions.identity import utc_day
from ..session import neighbour, prefix_scan

DAY = ["vault_id", "day_start"]


def drop_late(observations: DataFrame) -> DataFrame:
    """Adds ``day_start`` and drops rows that arrive after their vault has seen a later day.

    The closing arrival of a day is a suffix minimum over one row per (vault, day).
    """
    rows = observations.withColumn("day_start", utc_day(F.col("observed_at")))
    first = rows.groupBy(*DAY).agg(F.min("arrival").alias("first_arrival"))
    later = Window.partitionBy("vault_id").orderBy("day_start").rowsBetween(1, Window.unboundedFollowing)
    closing = first.select(*DAY, F.min("first_arrival").over(later).alias("closed_at"))
    joined = rows.join(closing, DAY)
    return joined.filter("closed_at is null or arrival < closed_at").drop("closed_at")


def bounded_clients(kept: DataFrame, limit: int | None = None) -> DataFrame:
    """Clients of a vault's day in order of arrival with their request counts; only the first ``limit`` if given."""
    counts = kept.groupBy(*DAY, "client_id").agg(
        F.min("arrival").alias("first_arrival"),
        F.count_if(F.col("protocol") == "rest").alias("requests_rest"),
        F.count_if(F.col("protocol") == "mcp").alias("requests_mcp"),
    )
    order = Window.partitionBy(*DAY).orderBy("first_arrival")
    numbered = counts.withColumn("client_no", F.row_number().over(order))
    return numbered if limit is None else numbered.filter(F.col("client_no") <= limit)


def poll_cadence(kept: DataFrame, clients: DataFrame) -> DataFrame:
    """Shortest and longest interval between feed requests of a client's day.

    One request before its predecessor in arrival order poisons the day (NULL intervals).
    """
    feed = kept.filter("feed_request").select(*DAY, "client_id", "arrival", "observed_at")
    stepped = neighbour(feed, [*DAY, "client_id"], "arrival", F.col("observed_at"), "previous", forward=False)
    gap = F.col("observed_at") - F.col("previous")
    cadence = stepped.groupBy(*DAY, "client_id").agg(
        F.max(F.coalesce(gap < 0, F.lit(False))).alias("poisoned"), F.min(gap).alias("lo"), F.max(gap).alias("hi"),
        F.max("observed_at").alias("last_feed_request_at"),
    )
    return clients.select(*DAY, "client_id").join(cadence, [*DAY, "client_id"], "left").select(
        *DAY, "client_id", "last_feed_request_at", F.coalesce("poisoned", F.lit(False)).alias("poll_cadence_incomplete"),
        F.when(~F.col("poisoned"), F.col("lo")).alias("minimum_poll_interval_ms"),
        F.when(~F.col("poisoned"), F.col("hi")).alias("maximum_poll_interval_ms"),
    )


def daily_requests(kept: DataFrame, limit: int = K.MAX_DAILY_CLIENTS) -> DataFrame:
    """Request totals of a vault's day; clients past the limit only make coverage incomplete."""
    per_client = kept.groupBy(*DAY, "client_id").agg(
        F.count_if(F.col("protocol") == "rest").alias("r"), F.count_if(F.col("protocol") == "mcp").alias("m"),
        F.min("observed_at").alias("lo"), F.max("observed_at").alias("hi"),
    )
    return per_client.groupBy(*DAY).agg(
        F.sum("r").alias("requests_rest"), F.sum("m").alias("requests_mcp"), F.min("lo").alias("request_observed_from"),
        F.max("hi").alias("request_observed_through"), (F.count(F.lit(1)) > limit).alias("coverage_incomplete"),
    )


def bounded_samples(kept: DataFrame, limit: int = K.MAX_DAILY_SAMPLES) -> DataFrame:
    """Latest ``limit`` samples of a day by observation time (later arrivals win ties).

    The literal bound lets Spark cut every input partition before the shuffle.
    """
    order = Window.partitionBy(*DAY).orderBy(F.col("observed_at").desc(), F.col("arrival").desc())
    samples = kept.filter("feed_request").select(*DAY, "observed_at", "arrival", "duration_ms")
    return samples.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= limit).drop("n")


def feed_p95(kept: DataFrame, share: float = 0.95, limit: int | None = None) -> DataFrame:
    """Nearest-rank p95 of a day's feed samples: all of them, or the latest ``limit`` if given.

    Samples are counted per distinct duration first; the rank is found among those counts.
    """
    feed = kept.filter("feed_request").select(*DAY, "observed_at", "duration_ms")
    used = feed if limit is None else bounded_samples(kept, limit)
    total = feed.groupBy(*DAY).agg(F.count(F.lit(1)).alias("total_sample_count"))
    day = used.groupBy(*DAY).agg(
        F.count(F.lit(1)).alias("sample_count"), F.min("observed_at").alias("first_sample_at"), F.max("observed_at").alias("last_sample_at")
    )
    counts = used.groupBy(*DAY, "duration_ms").agg(F.count(F.lit(1)).alias("n"))
    reached = F.sum("n").over(Window.partitionBy(*DAY).orderBy("duration_ms").rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.withColumn("reached", reached).join(day.select(*DAY, "sample_count"), DAY)
    p95 = ranked.filter(F.col("reached") >= F.ceil(F.lit(share) * F.col("sample_count"))).groupBy(*DAY).agg(F.min("duration_ms").alias("p95"))
    return p95.join(day, DAY).join(total, DAY)


def measurement_report(kept: DataFrame, now_ms: int) -> DataFrame:
    """Newest day per vault with freshness: a clock behind the data makes it unknown, data
    older than ten minutes is stale, and a known zero differs from unknown."""
    daily = daily_requests(kept).join(feed_p95(kept), DAY, "left")
    newest = daily.groupBy("vault_id").agg(F.max_by(F.struct(*[c for c in daily.columns if c != "vault_id"]), "day_start").alias("d"))
    day = newest.select("vault_id", "d.*")
    through = F.greatest("request_observed_through", F.coalesce("last_sample_at", "request_observed_through"))
    back = F.lit(now_ms) < through
    known = ~F.col("back")
    return day.withColumn("back", back).select(
        *DAY,
        F.when(known, "observed").otherwise("unknown").alias("status"),
        F.when(known & ~F.col("coverage_incomplete"), "partial").otherwise("unknown").alias("coverage"),
        F.when(known, F.col("requests_rest") + F.col("requests_mcp")).alias("requests"),
        (F.col("back") | (now_ms - F.col("request_observed_through") > K.METRICS_STALE_MS)).alias("requests_stale"),
        F.when(known & F.col("last_sample_at").isNotNull(), "observed").otherwise("unknown").alias("latency_status"),
        F.when(known, F.col("p95")).alias("p95"),
        (F.col("back") | F.col("last_sample_at").isNull() | (now_ms - F.col("last_sample_at") > K.METRICS_STALE_MS)).alias("latency_stale"),
        F.coalesce("sample_count", F.lit(0)).alias("sample_count"),
        F.coalesce("total_sample_count", F.lit(0)).alias("total_sample_count"),
    )


def validate_measurements(rows: DataFrame) -> DataFrame:
    """Invariants of a daily row before it is shown; ``reason`` is NULL for good rows."""
    day_end = F.col("day_start") + K.DAY_MS
    inside = F.col("request_observed_from").between(F.col("day_start"), day_end - 1) & F.col("request_observed_through").between(
        F.col("day_start"), day_end - 1
    )
    return rows.withColumn(
        "reason",
        F.when(F.col("day_start") % K.DAY_MS != 0, "day_not_utc_midnight")
        .when(~inside, "window_outside_day")
        .when(F.col("request_observed_from") > F.col("request_observed_through"), "window_reversed")
        .when((F.col("requests_rest") < 0) | (F.col("requests_mcp") < 0), "negative_count")
        .when(F.coalesce("sample_count", F.lit(0)) > F.coalesce("total_sample_count", F.lit(0)), "sample_count")
        .when((F.coalesce("sample_count", F.lit(0)) == 0) != F.col("p95").isNull(), "p95_presence"),
    )


def admission_load(tickets: DataFrame) -> DataFrame:
    """Live tickets of client and vault at each admission, over the event order of starts and ends.

    A ticket that ends exactly when another starts is no longer live. Both running sums go over the same
    slices of one sort, so neither a crowded vault nor a busy client is one task.
    """
    start = tickets.select("vault_id", "client_id", F.col("admitted_at").alias("t"), F.lit(1).alias("step"), "ticket_id")
    end = tickets.select("vault_id", "client_id", F.col("expires_at").alias("t"), F.lit(-1).alias("step"), "ticket_id")
    live = prefix_scan(
        start.unionByName(end), ["vault_id"], ["t", "step", "ticket_id"],
        {"vault_live": F.col("step"), "client_live": F.col("step")}, finer={"client_live": ["client_id"]},
    )
    return live.filter("step = 1").select(
        "vault_id", "client_id", "ticket_id", F.col("t").alias("admitted_at"), "client_live", "vault_live",
        (F.col("client_live") > K.CLIENT_TICKETS).alias("client_limited"), (F.col("vault_live") > K.VAULT_TICKETS).alias("vault_limited"),
    )


def retry_after(tickets: DataFrame, now_ms: int) -> DataFrame:
    """Per client at ``now_ms``: live tickets, and seconds to the earliest expiry if at the limit."""
    live = tickets.filter((F.col("admitted_at") <= now_ms) & (F.col("expires_at") > now_ms))
    out = live.groupBy("vault_id", "client_id").agg(F.count(F.lit(1)).alias("live"), F.min("expires_at").alias("earliest"))
    wait = F.greatest(F.lit(1), F.ceil((F.col("earliest") - now_ms) / F.lit(1000.0)).cast("int"))
    return out.select("vault_id", "client_id", "live", F.when(F.col("live") >= K.CLIENT_TICKETS, wait).alias("retry_after_seconds"))
