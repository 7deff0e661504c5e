"""Registered queries: daily metrics, freshness, admission load."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..operators import metrics as M
from .catalog import Area

AREA = Area()

_KEPT = {
    "dated": "SELECT *, observed_at // 86400000 * 86400000 AS day_start FROM observations",
    "flow": "SELECT *, max(day_start) OVER (PARTITION BY vault_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS current_day FROM dated",
    "kept": "SELECT * FROM flow WHERE day_start = current_day",
}
_CLIENTS = _KEPT | {
    "per_client": """SELECT vault_id, day_start, client_id, min(arrival) AS first_arrival, count(*) FILTER (protocol = 'rest') AS requests_rest,
  count(*) FILTER (protocol = 'mcp') AS requests_mcp FROM kept GROUP BY ALL""",
    "numbered": "SELECT *, CAST(row_number() OVER (PARTITION BY vault_id, day_start ORDER BY first_arrival) AS INT) AS client_no FROM per_client",
}
_DAILY = """SELECT vault_id, day_start, count(*) FILTER (protocol = 'rest') AS requests_rest, count(*) FILTER (protocol = 'mcp') AS requests_mcp,
  min(observed_at) AS request_observed_from, max(observed_at) AS request_observed_through, count(DISTINCT client_id) > 128 AS coverage_incomplete
FROM kept GROUP BY vault_id, day_start"""
_SAMPLES = _KEPT | {
    "ranked": "SELECT *, row_number() OVER (PARTITION BY vault_id, day_start ORDER BY observed_at DESC, arrival DESC) AS n, count(*) OVER (PARTITION BY vault_id, day_start) AS total FROM kept WHERE feed_request",
    "latest": "SELECT *, row_number() OVER (PARTITION BY vault_id, day_start ORDER BY duration_ms) AS r, count(*) OVER (PARTITION BY vault_id, day_start) AS c FROM ranked",
    "p": """SELECT vault_id, day_start, max(duration_ms) FILTER (r = ceil(0.95 * c)) AS p95, count(*) AS sample_count, min(observed_at) AS first_sample_at,
  max(observed_at) AS last_sample_at, max(total) AS total_sample_count FROM latest GROUP BY vault_id, day_start""",
}


@AREA.add("a9_daily_requests", "observations", steps=_KEPT, sql=_DAILY)
def _daily(observations):
    return M.daily_requests(M.drop_late(observations))


@AREA.add("t14_drop_late", "observations", steps=_KEPT, sql="SELECT vault_id, arrival, day_start, observed_at FROM kept")
def _kept(observations):
    return M.drop_late(observations).select("vault_id", "arrival", "day_start", "observed_at")


@AREA.add("w6_bounded_clients", "observations", steps=_CLIENTS, sql="SELECT * FROM numbered WHERE client_no <= 128")
def _clients(observations):
    return M.bounded_clients(M.drop_late(observations), K.MAX_DAILY_CLIENTS)


@AREA.add("w6_first_twenty_clients", "observations", steps=_CLIENTS, sql="SELECT * FROM numbered WHERE client_no <= 20")
def _few(observations):
    return M.bounded_clients(M.drop_late(observations), 20)


_CADENCE = _CLIENTS | {
    "fed": "SELECT *, observed_at - lag(observed_at) OVER (PARTITION BY vault_id, day_start, client_id ORDER BY arrival) AS gap FROM kept WHERE feed_request",
    "c": "SELECT vault_id, day_start, client_id, max(observed_at) AS last_at, coalesce(min(gap) < 0, false) AS bad, min(gap) AS lo, max(gap) AS hi FROM fed GROUP BY ALL",
}


@AREA.add(
    "a11_w4_poll_cadence", "observations", steps=_CADENCE,
    sql="""SELECT n.vault_id, n.day_start, n.client_id, c.last_at AS last_feed_request_at, coalesce(c.bad, false) AS poll_cadence_incomplete,
  CASE WHEN NOT c.bad THEN c.lo END AS minimum_poll_interval_ms, CASE WHEN NOT c.bad THEN c.hi END AS maximum_poll_interval_ms
FROM numbered n LEFT JOIN c ON n.vault_id = c.vault_id AND n.day_start = c.day_start AND n.client_id = c.client_id""",
)
def _cadence(observations):
    kept = M.drop_late(observations)
    return M.poll_cadence(kept, M.bounded_clients(kept))


@AREA.add("w5_bounded_samples", "observations", steps=_SAMPLES, sql="SELECT vault_id, day_start, observed_at, arrival, duration_ms FROM ranked WHERE n <= 2048")
def _samples(observations):
    return M.bounded_samples(M.drop_late(observations))


@AREA.add("a10_feed_p95", "observations", steps=_SAMPLES, sql="SELECT * FROM p")
def _p95(observations):
    return M.feed_p95(M.drop_late(observations))


_NOW = 1706659200000 - 5 * 60_000


@AREA.add(
    "a16_measurement_report", "observations",
    steps=_SAMPLES | {
        "daily": _DAILY,
        "newest": "SELECT d.*, p.p95, p.sample_count, p.total_sample_count, p.last_sample_at FROM daily d LEFT JOIN p ON d.vault_id = p.vault_id AND d.day_start = p.day_start QUALIFY row_number() OVER (PARTITION BY d.vault_id ORDER BY d.day_start DESC) = 1",
        "b": f"SELECT *, {_NOW} < greatest(request_observed_through, coalesce(last_sample_at, request_observed_through)) AS back FROM newest",
    },
    sql=f"""SELECT vault_id, day_start, CASE WHEN back THEN 'unknown' ELSE 'observed' END AS status, CASE WHEN NOT back AND NOT coverage_incomplete THEN 'partial' ELSE 'unknown' END AS coverage,
  CASE WHEN NOT back THEN requests_rest + requests_mcp END AS requests, back OR {_NOW} - request_observed_through > 600000 AS requests_stale,
  CASE WHEN NOT back AND last_sample_at IS NOT NULL THEN 'observed' ELSE 'unknown' END AS latency_status, CASE WHEN NOT back THEN p95 END AS p95,
  back OR last_sample_at IS NULL OR {_NOW} - last_sample_at > 600000 AS latency_stale, coalesce(sample_count, 0) AS sample_count, coalesce(total_sample_count, 0) AS total_sample_count FROM b""",
)
def _report(observations):
    return M.measurement_report(M.drop_late(observations), _NOW)


@AREA.add(
    "s13_validate_measurements", "observations",
    steps=_SAMPLES | {
        "daily": _DAILY,
        "broken": """SELECT d.vault_id, d.day_start + CASE WHEN d.day_start // 86400000 % 3 = 0 THEN 1 ELSE 0 END AS day_start, d.requests_rest, d.requests_mcp, d.request_observed_from,
  d.request_observed_through + CASE WHEN d.day_start // 86400000 % 3 = 1 THEN 86400000 ELSE 0 END AS request_observed_through, p.p95, p.sample_count, p.total_sample_count
FROM daily d LEFT JOIN p ON d.vault_id = p.vault_id AND d.day_start = p.day_start""",
    },
    sql="""SELECT vault_id, day_start, CASE WHEN day_start % 86400000 <> 0 THEN 'day_not_utc_midnight'
  WHEN request_observed_through >= day_start + 86400000 THEN 'window_outside_day' END AS reason FROM broken""",
)
def _validate(observations):
    kept = M.drop_late(observations)
    third = F.floor(F.col("day_start") / 86_400_000) % 3
    rows = M.daily_requests(kept).join(M.feed_p95(kept), M.DAY, "left").withColumns(
        {"request_observed_through": F.col("request_observed_through") + F.when(third == 1, 86_400_000).otherwise(0),
         "day_start": F.col("day_start") + F.when(third == 0, 1).otherwise(0)}
    )
    return M.validate_measurements(rows).select("vault_id", "day_start", "reason")


_MOVES = {
    "moves": """SELECT vault_id, client_id, admitted_at AS t, 1 AS step, ticket_id FROM tickets UNION ALL SELECT vault_id, client_id, expires_at, -1, ticket_id FROM tickets""",
    "run": """SELECT *, sum(step) OVER (PARTITION BY vault_id ORDER BY t, step, ticket_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v,
  sum(step) OVER (PARTITION BY vault_id, client_id ORDER BY t, step, ticket_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM moves""",
}


@AREA.add(
    "a14_admission_load", "tickets", steps=_MOVES,
    sql="""SELECT vault_id, client_id, ticket_id, t AS admitted_at, CAST(c AS BIGINT) AS client_live, CAST(v AS BIGINT) AS vault_live, c > 16 AS client_limited, v > 1024 AS vault_limited
FROM run WHERE step = 1""",
)
def _load(tickets):
    return M.admission_load(tickets)


@AREA.add(
    "a14_retry_after", "tickets",
    sql="""SELECT vault_id, client_id, count(*) AS live, CASE WHEN count(*) >= 16 THEN greatest(1, CAST(ceil((min(expires_at) - 1705276800000) / 1000.0) AS INT)) END AS retry_after_seconds
FROM tickets WHERE admitted_at <= 1705276800000 AND expires_at > 1705276800000 GROUP BY vault_id, client_id""",
)
def _retry(tickets):
    return M.retry_after(tickets, 1705276800000)
