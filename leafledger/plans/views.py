"""Scans as a user asks for them: pruned columns, one vault or path, ranges of the feed."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.lifecycle import validate_inventory
from ..sources import tables
from .catalog import Area

AREA = Area()


@AREA.add("s1_scan_files", "notes", sql="SELECT * EXCLUDE (content) FROM notes WHERE vault_id = 'v1'")
def _files(notes):
    return tables.scan_files(notes, vault_id="v1")


@AREA.add("s1_scan_files_with_text", "notes", sql="SELECT vault_id, path, SHA(content) AS text_hash FROM notes")
def _texts(notes):
    return tables.scan_files(notes, content=True).select("vault_id", "path", F.sha2("content", 256).alias("text_hash"))


@AREA.add("s2_scan_revisions", "revisions", sql="SELECT vault_id, path, rev, hash, deleted FROM revisions WHERE vault_id = 'v2' AND rev = 2")
def _revisions(revisions):
    return tables.scan_revisions(revisions, vault_id="v2", rev=2).select("vault_id", "path", "rev", "hash", "deleted")


@AREA.add("s3_scan_feed", "changes", sql="SELECT * FROM changes WHERE seq > 100 AND seq <= 900")
def _feed(changes):
    return tables.read_feed(changes, after_seq=100, head_seq=900)


@AREA.add("s4_scan_receipts", "receipts", sql="SELECT * EXCLUDE (arrival) FROM receipts")
def _receipts(receipts):
    return tables.scan_receipts(receipts)


@AREA.add(
    "s5_scan_blob_inventory", "inventory",
    steps={
        "spoilt": """SELECT vault_id, CASE WHEN substr(hash, 1, 1) = '0' THEN concat('x', substr(hash, 2)) ELSE hash END AS hash,
  CASE WHEN substr(hash, 1, 1) = '1' THEN -1 ELSE size END AS size, substr(hash, 1, 1) AS k FROM inventory""",
    },
    sql="""SELECT vault_id, hash, size, CASE k WHEN '0' THEN 'invalid_hash' WHEN '1' THEN 'invalid_size' WHEN '2' THEN 'duplicate_hash' END AS reason FROM spoilt
UNION ALL SELECT vault_id, hash, size, 'duplicate_hash' FROM spoilt WHERE k = '2'""",
)
def _inventory(inventory):
    """A listing with malformed and repeated hashes and impossible sizes."""
    first = F.substring("hash", 1, 1)
    spoilt = inventory.withColumns(
        {"hash": F.when(first == "0", F.concat(F.lit("x"), F.expr("substring(hash, 2)"))).otherwise(F.col("hash")), "size": F.when(first == "1", F.lit(-1).cast("long")).otherwise(F.col("size"))}
    )
    return validate_inventory(tables.scan_blob_inventory(spoilt.unionByName(spoilt.filter(F.substring("hash", 1, 1) == "2"))))


@AREA.add("s12_scan_observations", "observations", sql="SELECT * FROM observations WHERE feed_request AND duration_ms > 50")
def _observations(observations):
    return tables.scan_observations(observations).filter("feed_request AND duration_ms > 50")
