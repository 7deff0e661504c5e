"""Registered queries: state, pages, listings, slices, summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reads as R
from .bridge import EPOCH, VIEWS
from .catalog import Area

AREA = Area()

_TAG = f"""concat('"{EPOCH}.', CAST(rev AS STRING), '"')"""
_SHOWN = f"""SELECT vault_id, path, {_TAG} AS etag, seq, CASE WHEN deleted THEN '' ELSE hash END AS hash, CASE WHEN deleted THEN 0 ELSE size END AS size, kind, deleted,
  NOT deleted AND kind = 'blob' AND size > 1000000 AND (lower(path) LIKE '%.md' OR lower(path) LIKE '%.canvas') AS large FROM notes"""


@AREA.add(
    "w1_current_state", "revisions",
    sql="SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY vault_id, path ORDER BY rev DESC) AS n FROM revisions) t WHERE n = 1",
)
def _current(revisions):
    return R.current_state(revisions)


@AREA.add("p8_p9_manifest_rows", "notes", sql=_SHOWN)
def _manifest(notes):
    return R.manifest_rows(notes, EPOCH)


@AREA.add(
    "o1_manifest_page", "notes", steps={"shown": _SHOWN},
    sql="SELECT * FROM shown WHERE vault_id = 'v1' AND encode(path) > encode('src12/') ORDER BY encode(path) LIMIT 257",
)
def _page(notes):
    return R.manifest_page(notes, "v1", EPOCH, after="src12/")


@AREA.add("o2_changes_page", "changes", sql="SELECT * FROM changes WHERE vault_id = 'v2' AND seq > 700 AND seq <= 2500 ORDER BY seq LIMIT 1000")
def _changes(changes):
    return R.changes_page(changes, "v2", 700, 2500)


@AREA.add(
    "o3_history_page", "revisions",
    sql=f"""SELECT vault_id, path, rev, {_TAG} AS etag, hash, size, deleted, origin, at_ms FROM revisions
WHERE vault_id = 'v1' AND path = 'Notes/u7/p1.md' AND rev > 2 AND rev <= 40 ORDER BY rev LIMIT 257""",
)
def _history(revisions):
    return R.history_page(revisions, "v1", "Notes/u7/p1.md", EPOCH, after=2, upper=40)


def _listing_sql(kinds: str) -> str:
    return f"SELECT vault_id, path, {_TAG} AS etag, size, updated_at, kind = 'blob' AND size > 1000000 AS large FROM notes WHERE NOT deleted AND ({kinds})"


@AREA.add("p11_list_notes", "notes", sql=_listing_sql("lower(path) LIKE '%.md' OR lower(path) LIKE '%.canvas'"))
def _notes(notes):
    return R.list_notes(notes, EPOCH)


@AREA.add("p12_list_bases", "notes", sql=_listing_sql("lower(path) LIKE '%.base'"))
def _bases(notes):
    return R.list_bases(notes, EPOCH, include_large=True)


# A read of every document's path: stale tags, absent paths, slices of several lengths.
VIEWS["asked"] = """
SELECT concat('v', CAST(doc_id % 3 AS STRING)) AS vault_id, CASE WHEN doc_id % 11 = 5 THEN concat('none/', source) ELSE n.path END AS path, doc_id AS request_id,
  CASE WHEN doc_id % 4 = 1 THEN '"0123456789abcdef0123456789abcdef.1"' END AS etag,
  CASE WHEN doc_id % 5 > 0 THEN doc_id % 700 END AS "offset", CASE WHEN doc_id % 6 > 0 THEN doc_id % 900 END AS "length"
FROM documents JOIN notes n ON n.seq = doc_id + 1""".replace('"offset"', "offset_").replace('"length"', "length_")


@AREA.add(
    "p13_p14_read_notes", "asked", "notes",
    steps={
        "joined": "SELECT a.*, n.rev, n.kind, n.deleted, n.content FROM asked a LEFT JOIN notes n ON a.vault_id = n.vault_id AND a.path = n.path",
        "judged": f"""SELECT *, CASE WHEN rev IS NULL THEN 'not_found' WHEN deleted THEN 'tombstone' WHEN etag <> {_TAG} THEN 'stale_etag'
  WHEN kind <> 'text' THEN 'not_text' END AS reason FROM joined""",
    },
    sql=f"""SELECT vault_id, path, request_id, reason, CASE WHEN rev IS NOT NULL THEN {_TAG} END AS current_etag,
  CASE WHEN reason IS NULL THEN SHA(substr(content, CAST(coalesce(offset_, 0) + 1 AS INT), CAST(coalesce(length_, length(content)) AS INT))) END AS piece,
  CASE WHEN reason IS NULL THEN coalesce(offset_, 0) + coalesce(length_, length(content)) < length(content) END AS truncated FROM judged""",
)
def _read(asked, notes):
    requests = asked.withColumnsRenamed({"offset_": "offset", "length_": "length"})
    out = R.read_notes(requests, notes, EPOCH)
    return out.select("vault_id", "path", "request_id", "reason", "current_etag", F.sha2("text", 256).alias("piece"), "truncated")


@AREA.add(
    "j16_resolve_pinned", "ops", "revisions",
    steps={
        "wanted": "SELECT vault_id, arrival, path, 1 + arrival % 9 AS rev FROM ops",
        "kept": "SELECT * FROM revisions WHERE at_ms % 3 > 0",
        "newest": "SELECT vault_id, path, max(rev) AS current_rev, arg_max(hash, rev) AS hash, arg_max(content, rev) AS content FROM revisions GROUP BY vault_id, path",
    },
    sql="""SELECT w.vault_id, w.arrival, w.path, w.rev, n.current_rev, CASE WHEN k.rev IS NOT NULL THEN 'revision' WHEN n.current_rev = w.rev THEN 'current' ELSE 'revision_pruned' END AS found,
  CASE WHEN k.rev IS NOT NULL THEN k.hash WHEN n.current_rev = w.rev THEN n.hash END AS hash
FROM wanted w LEFT JOIN kept k ON w.vault_id = k.vault_id AND w.path = k.path AND w.rev = k.rev
LEFT JOIN newest n ON w.vault_id = n.vault_id AND w.path = n.path""",
)
def _pinned(ops, revisions):
    wanted = ops.select("vault_id", "arrival", "path", (F.col("arrival") % 9 + 1).alias("rev"))
    kept = revisions.filter(F.col("at_ms") % 3 > 0)
    return R.resolve_pinned(wanted, kept, R.current_state(revisions)).drop("content")


@AREA.add(
    "j17_rename_targets", "notes",
    steps={"moved": "SELECT vault_id, path, rev, CASE WHEN renamed_to IS NOT NULL THEN replace(replace(path, 'Doc-', 'Doc-'), path, renamed_to) END AS renamed_to FROM notes WHERE deleted AND renamed_to IS NOT NULL"},
    sql="""SELECT m.vault_id, m.path, m.rev, m.renamed_to, n.rev AS to_rev, n.deleted AS to_deleted FROM moved m LEFT JOIN (
  SELECT vault_id, path, rev, deleted FROM notes UNION ALL SELECT vault_id, renamed_to, rev + 1, false FROM moved WHERE rev % 2 = 1) n
ON m.vault_id = n.vault_id AND m.renamed_to = n.path""",
)
def _targets(notes):
    moved = notes.filter(F.col("deleted") & F.col("renamed_to").isNotNull() & (F.col("rev") % 2 == 1))
    landed = moved.withColumns({"path": F.col("renamed_to"), "rev": F.col("rev") + 1, "deleted": F.lit(False), "renamed_to": F.lit(None).cast("string")})
    return R.rename_target(notes.unionByName(landed))


@AREA.add(
    "j8_path_collisions", "notes",
    steps={"pairs": "SELECT vault_id, path, deleted FROM notes UNION ALL SELECT vault_id, upper(path), deleted FROM notes WHERE substr(hash,1,1) = '5'"},
    sql="""SELECT vault_id, lower(path) AS path_key, path FROM pairs WHERE NOT deleted AND (vault_id, lower(path)) IN (
  SELECT (vault_id, lower(path)) FROM pairs WHERE NOT deleted GROUP BY vault_id, lower(path) HAVING count(DISTINCT path) > 1)""".replace(
        "(vault_id, lower(path)) IN (\n  SELECT (vault_id, lower(path))", "concat(vault_id, '|', lower(path)) IN (\n  SELECT concat(vault_id, '|', lower(path))"
    ),
)
def _collisions(notes):
    rows = notes.select("vault_id", "path", "deleted", "hash")
    twins = rows.filter(F.substring("hash", 1, 1) == "5").withColumn("path", F.upper("path"))
    return R.path_collisions(rows.unionByName(twins))


@AREA.add(
    "a1_vault_summary", "notes",
    sql="SELECT vault_id, count(*) FILTER (NOT deleted) AS live, count(*) FILTER (deleted) AS deleted, max(seq) AS head_seq FROM notes GROUP BY vault_id",
)
def _summary(notes):
    return R.vault_summary(notes)


_NOW = 1704067200000 + 45 * 86_400_000
_FLOOR = f"""SELECT vault_id, max(seq) AS head_seq, greatest(coalesce(min(seq) FILTER (at_ms >= {_NOW} - 2592000000), 0), coalesce(max(seq) FILTER (at_ms < {_NOW} - 2592000000) + 1, 0)) AS floor
FROM changes GROUP BY vault_id"""


@AREA.add("a12_feed_floor", "changes", sql=_FLOOR)
def _floor(changes):
    return R.feed_floor(changes, _NOW)


@AREA.add(
    "t16_cursor_expiry", "changes", "clients",
    steps={"floors": _FLOOR, "cursors": "SELECT vault_id, client_id, generation * 1000 + CAST(length(name) AS BIGINT) + created_at % 997 AS since FROM clients"},
    sql="SELECT c.vault_id, c.client_id, c.since, f.floor, CASE WHEN c.since < f.floor - 1 THEN 'cursor_expired' END AS reason FROM cursors c JOIN floors f ON c.vault_id = f.vault_id",
)
def _expiry(changes, clients):
    since = F.col("generation") * 1000 + F.char_length("name").cast("long") + F.col("created_at") % 997
    cursors = clients.select("vault_id", "client_id", since.alias("since"))
    return R.expired_cursors(cursors, R.feed_floor(changes, _NOW).drop("head_seq"))
