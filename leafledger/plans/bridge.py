"""Deterministic projections of the given tables onto the vault tables.

Each projection is one SQL text. ``SHA``, ``BLEN``, ``MS`` and ``NFCKEY`` are the only
dialect differences; ``spark_table`` and ``duckdb_with`` fill them in.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

GIVEN = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

EPOCH = "0123456789abcdef0123456789abcdef"

VIEWS = {
    "notes": """
SELECT concat('v', CAST(doc_id % 3 AS STRING)) AS vault_id,
  concat(source,'/',lang,'/Doc-',CAST(doc_id AS STRING),
    CASE WHEN doc_id % 10 = 6 THEN '.MD' WHEN doc_id % 10 = 7 THEN '.canvas' WHEN doc_id % 10 = 8 THEN '.base'
         WHEN doc_id % 10 = 9 THEN '.png' ELSE '.md' END) AS path,
  1 + doc_id % 4 AS rev, doc_id + 1 AS seq,
  CASE WHEN doc_id % 13 = 0 THEN '' ELSE SHA(text) END AS hash,
  CASE WHEN doc_id % 13 = 0 THEN 0 ELSE CAST(BLEN(text) AS BIGINT) END AS size,
  CASE WHEN doc_id % 10 = 9 THEN 'blob' ELSE 'text' END AS kind,
  CASE WHEN doc_id % 13 = 0 OR doc_id % 10 = 9 THEN NULL ELSE text END AS content,
  CASE WHEN doc_id % 10 = 9 THEN SHA(text) END AS blob_hash,
  CASE WHEN doc_id % 26 = 0 THEN concat(source,'/',lang,'/Moved-',CAST(doc_id AS STRING),'.md') END AS renamed_to,
  doc_id % 13 = 0 AS deleted, 1704067200000 + doc_id * 60000 AS updated_at,
  concat('c', CAST(doc_id % 4 AS STRING)) AS origin
FROM documents""",
    "ops": """
SELECT vault_id, arrival, path, CASE WHEN event_type = 'error' AND expected_rev > 0 THEN 'delete' ELSE 'put' END AS op,
  client_id, op_key, payload_hash, payload, expected_rev, at_ms
FROM (
  SELECT concat('v', CAST(user_id % 3 AS STRING)) AS vault_id, event_id + 1 AS arrival, event_type,
    concat('Notes/u', CAST(user_id AS STRING), '/p', CAST(event_id % 5 AS STRING), '.md') AS path,
    concat('c', CAST(user_id % 4 AS STRING)) AS client_id,
    concat('op-', CAST(event_id - CASE WHEN event_id % 11 = 10 THEN 1 ELSE 0 END AS STRING)) AS op_key,
    SHA(props) AS payload_hash, props AS payload,
    CAST(sum(CASE WHEN event_id % 7 <> 0 THEN 1 ELSE 0 END) OVER w AS BIGINT)
      - CASE WHEN event_id % 7 <> 0 THEN 1 ELSE 0 END + CASE WHEN event_id % 7 = 0 THEN 5 ELSE 0 END AS expected_rev,
    MS(ts) AS at_ms
  FROM events
  WINDOW w AS (PARTITION BY user_id, event_id % 5 ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
) t""",
    "revisions": """
SELECT vault_id, path, expected_rev + 1 AS rev, CASE WHEN op = 'delete' THEN '' ELSE payload_hash END AS hash,
  CASE WHEN op = 'delete' THEN 0 ELSE CAST(BLEN(payload) AS BIGINT) END AS size,
  CASE WHEN path LIKE '%/p4.md' THEN 'blob' ELSE 'text' END AS kind,
  CASE WHEN op = 'delete' OR path LIKE '%/p4.md' THEN NULL ELSE payload END AS content,
  CASE WHEN path LIKE '%/p4.md' THEN payload_hash END AS blob_hash,
  op = 'delete' AS deleted, client_id AS origin, at_ms, arrival
FROM ops WHERE (arrival - 1) % 7 <> 0""",
    "changes": """
SELECT vault_id, CAST(row_number() OVER (PARTITION BY vault_id ORDER BY arrival) AS BIGINT) AS seq,
  CASE WHEN deleted THEN 'delete' ELSE 'put' END AS op, path, rev, hash,
  CAST(NULL AS STRING) AS from_path, CAST(NULL AS BIGINT) AS from_rev, origin, at_ms
FROM revisions""",
    "receipts": """
SELECT vault_id, client_id, op_key, SHA(concat(op, '|', path, '|', payload_hash)) AS fingerprint, 201 AS status,
  concat('{"seq":', CAST(arrival AS STRING), '}') AS body, at_ms, arrival
FROM (
  SELECT o.*, row_number() OVER (PARTITION BY vault_id, client_id, op_key ORDER BY arrival) AS n
  FROM ops o WHERE (arrival - 1) % 7 <> 0
) t WHERE n = 1""",
    "pins": "SELECT vault_id, path, rev, 'x1' AS export_id FROM changes WHERE seq % 17 = 0",
    "inventory": """
SELECT vault_id, hash, max(size) AS size FROM (
  SELECT vault_id, blob_hash AS hash, size FROM notes WHERE blob_hash IS NOT NULL AND NOT deleted
  UNION ALL
  SELECT vault_id, blob_hash, size FROM revisions WHERE blob_hash IS NOT NULL
  UNION ALL
  SELECT concat('v', CAST(page_id % 3 AS STRING)), SHA(html), CAST(BLEN(html) AS BIGINT) FROM pages
) t GROUP BY vault_id, hash""",
    "exports": """
SELECT concat('x', CAST(n_nationkey AS STRING)) AS export_id, concat('v', CAST(n_nationkey % 3 AS STRING)) AS vault_id,
  CASE n_regionkey WHEN 0 THEN 'queued' WHEN 1 THEN 'uploading' WHEN 2 THEN 'complete' ELSE 'failed' END AS status,
  1704067200000 + n_nationkey * 3600000 AS created_at, CAST(n_nationkey AS BIGINT) AS head_seq
FROM nation""",
    "export_files": """
SELECT concat('x', CAST(page_id % 25 AS STRING)) AS export_id, concat('v', CAST(page_id % 25 % 3 AS STRING)) AS vault_id,
  url AS path, SHA(html) AS hash, CAST(BLEN(html) AS BIGINT) AS size,
  CASE WHEN page_id % 2 = 0 THEN 'blob' ELSE 'text' END AS source_type
FROM pages""",
    "observations": """
SELECT concat('v', CAST(user_id % 3 AS STRING)) AS vault_id, concat('c', CAST(user_id AS STRING)) AS client_id,
  CASE WHEN event_type IN ('signup','error') THEN 'mcp' ELSE 'rest' END AS protocol,
  event_type = 'view' AS feed_request, MS(ts) - CASE WHEN event_id % 41 = 0 THEN 90000000 ELSE 0 END AS observed_at,
  CAST(floor(value) AS BIGINT) AS duration_ms, event_id AS arrival
FROM events""",
    "device": """
SELECT vault_id, path,
  CASE WHEN substr(hash,1,1) IN ('0','1','2') THEN SHA(concat(hash,'edit')) ELSE hash END AS local_hash,
  CASE WHEN substr(hash,4,1) = '7' THEN 26000000 ELSE size END AS local_size,
  CASE WHEN substr(hash,2,1) IN ('0','1') THEN NULL WHEN substr(hash,2,1) = '2' THEN SHA(concat(hash,'old')) ELSE hash END AS base_hash,
  CASE WHEN substr(hash,2,1) IN ('0','1') THEN NULL WHEN substr(hash,2,1) = '2' THEN rev - 1 ELSE rev END AS base_rev
FROM notes WHERE substr(hash,3,1) <> 'f' AND NOT deleted""",
    "local": """
SELECT 'd1' AS device_id, vault_id, path, local_hash AS hash, local_size AS size FROM device
WHERE substr(local_hash,5,1) <> '0'
UNION ALL
SELECT 'd1', concat('v', CAST(item_id % 3 AS STRING)), concat('Drafts/item-', CAST(item_id AS STRING), '.md'), SHA(text),
  CAST(BLEN(text) AS BIGINT) FROM benchmark""",
    "base": """
SELECT 'd1' AS device_id, vault_id, path, base_hash AS hash, base_rev AS rev, substr(base_hash,6,1) = '0' AS deleted,
  substr(base_hash,7,1) = '0' AS stale
FROM device WHERE base_rev IS NOT NULL""",
    "feed": """
SELECT 'd1' AS device_id, vault_id, seq, CASE WHEN deleted THEN 'delete' WHEN seq % 9 = 4 THEN 'rename' ELSE 'put' END AS op,
  path, rev, hash, size, CASE WHEN NOT deleted AND seq % 9 = 4 THEN concat('Old/', path) END AS from_path,
  CASE WHEN NOT deleted AND seq % 9 = 4 THEN rev + 1 END AS from_rev, origin, updated_at AS at_ms
FROM notes""",
    "device_ops": """
SELECT 'd1' AS device_id, vault_id, concat('k-', CAST(seq AS STRING)) AS op_key, seq AS arrival,
  CASE WHEN seq % 5 = 0 THEN 'delete' WHEN seq % 5 = 1 THEN 'rename' ELSE 'put' END AS op,
  CASE WHEN seq % 4 = 3 THEN upper(path) ELSE path END AS path,
  CASE WHEN seq % 5 = 1 THEN concat('Renamed/', path) END AS to_path,
  CASE WHEN seq % 3 = 0 THEN 'sent' WHEN seq % 3 = 1 THEN 'queued' ELSE 'resolved' END AS state,
  CASE WHEN seq % 5 < 2 OR seq % 2 = 0 THEN 'match' ELSE 'absent' END AS precondition,
  CASE WHEN seq % 5 < 2 OR seq % 2 = 0 THEN rev END AS expected_rev,
  hash AS payload_hash, CAST(NULL AS STRING) AS depends_on
FROM notes WHERE seq % 7 = 2""",
    "clients": """
SELECT concat('v', CAST(c_nationkey % 3 AS STRING)) AS vault_id, concat('k', CAST(c_custkey AS STRING)) AS client_id,
  c_name AS name, CAST(c_custkey % 3 AS BIGINT) AS generation, 1704067200000 + c_custkey * 60000 AS created_at,
  CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 1704067200000 + c_custkey * 61000 END AS last_seen_at
FROM customer""",
    "grants": """
SELECT concat('g', CAST(o_orderkey AS STRING)) AS grant_id, concat('k', CAST(o_custkey AS STRING)) AS client_id,
  MS(o_orderdate) AS created_at, o_orderpriority = '5-LOW' AND o_orderstatus = 'F' AS cleanup_pending
FROM orders WHERE o_custkey % 4 <> 1""",
    "revoked": """
SELECT concat('g', CAST(o_orderkey AS STRING)) AS grant_id, MS(o_orderdate) AS at_ms FROM orders WHERE o_orderstatus = 'F'""",
    "consents": """
SELECT concat('n', CAST(s_suppkey AS STRING)) AS consent_id, concat('k', CAST(s_suppkey AS STRING)) AS client_id,
  CAST(s_suppkey % 2 AS BIGINT) AS generation, 1704250000000 + s_suppkey * 5000 AS created_at
FROM supplier""",
    "requests": """
SELECT concat('v', CAST(user_id % 3 AS STRING)) AS vault_id, event_id + 1 AS arrival,
  concat('g', CAST(event_id % 1500 AS STRING)) AS grant_id,
  CASE event_type WHEN 'view' THEN 'read' WHEN 'error' THEN 'delete' WHEN 'click' THEN 'append' ELSE 'put' END AS op,
  user_id % 4 >= 1 AS can_write, user_id % 4 >= 2 AS can_delete,
  CASE WHEN event_id % 9 = 0 THEN 'ffffffffffffffffffffffffffffffff' WHEN event_id % 9 = 1 THEN NULL
       ELSE '0123456789abcdef0123456789abcdef' END AS epoch,
  CASE WHEN event_id % 9 = 1 AND event_id % 2 = 0 THEN 'ffffffffffffffffffffffffffffffff' END AS match_epoch,
  concat('Notes/u', CAST(user_id AS STRING), '/p', CAST(event_id % 5 AS STRING), '.md') AS path
FROM events""",
    "tickets": """
SELECT concat('v', CAST(user_id % 3 AS STRING)) AS vault_id, concat('c', CAST(user_id % 7 AS STRING)) AS client_id,
  event_id AS ticket_id, MS(ts) AS admitted_at, MS(ts) + 60000 * (1 + CAST(floor(value) AS BIGINT) % 600) AS expires_at
FROM events""",
    "local_events": """
SELECT 'd1' AS device_id, concat('v', CAST(user_id % 3 AS STRING)) AS vault_id, event_id AS arrival,
  concat('Notes/u', CAST(user_id AS STRING), '/p', CAST(event_id % 2 AS STRING), '.md') AS path,
  CASE event_type WHEN 'error' THEN 'delete' WHEN 'click' THEN 'rename' WHEN 'signup' THEN 'create' ELSE 'modify' END AS event,
  CASE WHEN event_type = 'click' THEN concat('Notes/u', CAST(user_id AS STRING), '/q', CAST(event_id % 2 AS STRING), '.md') END AS to_path,
  SHA(props) AS hash, MS(ts) AS at_ms
FROM events""",
    "event_base": """
SELECT DISTINCT 'd1' AS device_id, vault_id, path, 3 + CAST(length(path) % 3 AS BIGINT) AS rev,
  SHA(path) AS hash, path LIKE '%1/p%' AS deleted
FROM local_events WHERE path NOT LIKE '%2/p%'""",
    "snippets": """
SELECT concat('v', CAST(item_id % 3 AS STRING)) AS vault_id, item_id AS query_id,
  CASE item_id % 11 WHEN 9 THEN substr(text, 1, 2) WHEN 10 THEN text
    ELSE substr(text, 1 + CAST((item_id * 37) % greatest(length(text) - 8, 1) AS INT), 4 + CAST(item_id % 3 AS INT)) END AS query FROM benchmark""",
}

_TABLE = re.compile(r"\b(?:FROM|JOIN)\s+([a-z_]+)", re.I)


def _needs(sql: str) -> list[str]:
    return [t for t in dict.fromkeys(_TABLE.findall(sql))]


def _dialect(sql: str, engine: str) -> str:
    if engine == "spark":
        sql = re.sub(r"\bBLEN\(", "octet_length(", sql)
        sql = re.sub(r"\bSHA\(((?:[^()]|\([^()]*\))*)\)", r"sha2(\1, 256)", sql)
        return re.sub(r"\bMS\((\w+)\)", r"(unix_micros(CAST(\1 AS TIMESTAMP)) div 1000)", sql)
    sql = re.sub(r"\bBLEN\(", "strlen(", sql)
    sql = re.sub(r"\bSHA\(", "sha256(", sql)
    return re.sub(r"\bMS\((\w+)\)", r"(epoch_us(\1) // 1000)", sql)


def spark_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, or a projection of given tables, as a lazy DataFrame."""
    if name in GIVEN:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = VIEWS[name]
    used = [t for t in _needs(sql) if t in VIEWS or t in GIVEN]
    text = _dialect(sql, "spark").replace("{", "{{").replace("}", "}}")
    for t in used:
        text = re.sub(rf"\b((?:FROM|JOIN)\s+){t}\b", rf"\1{{{t}}}", text, flags=re.I)
    return spark.sql(text, **{t: spark_table(spark, sf_dir, t) for t in used})


def duckdb_with(query: str, extra: dict[str, str] | None = None) -> str:
    """``query`` preceded by the projections it uses (and ``extra`` named steps)."""
    extra = extra or {}
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order or name in GIVEN or name not in VIEWS:
            return
        for other in _needs(VIEWS[name]):
            visit(other)
        order.append(name)

    for text in [*extra.values(), query]:
        for name in _needs(text):
            visit(name)
    steps = [f"{n} AS ({_dialect(VIEWS[n], 'duckdb')})" for n in order]
    steps += [f"{n} AS ({_dialect(sql, 'duckdb')})" for n, sql in extra.items()]
    recursive = "RECURSIVE " if any("RECURSIVE_STEP" in s for s in steps) else ""
    steps = [s.replace("/*RECURSIVE_STEP*/", "") for s in steps]
    head = f"WITH {recursive}" + ",\n".join(steps) + "\n" if steps else ""
    return head + _dialect(query, "duckdb")
