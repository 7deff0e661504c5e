"""State, feed and history reads: current rows, pages, listings, slices and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.identity import format_etag
from ..functions.paths import classify_path, large_flag
from ..functions.unicode import path_key, utf16_length, utf16_slice


STATE_COLUMNS = ["rev", "hash", "size", "kind", "content", "blob_hash", "deleted", "origin", "at_ms"]


def current_state(revisions: DataFrame) -> DataFrame:
    """Newest row of every path, tombstones included (``max_by`` combines before the shuffle)."""
    columns = [c for c in revisions.columns if c not in ("vault_id", "path")]
    newest = F.max_by(F.struct(*columns), "rev").alias("s")
    return revisions.groupBy("vault_id", "path").agg(newest).select("vault_id", "path", "s.*")


def mask_tombstones(files: DataFrame) -> DataFrame:
    """Deleted rows show no hash and no bytes."""
    return files.withColumns(
        {
            "hash": F.when(F.col("deleted"), "").otherwise(F.col("hash")),
            "size": F.when(F.col("deleted"), F.lit(0).cast("long")).otherwise(F.col("size")),
        }
    )


def manifest_rows(files: DataFrame, epoch: str) -> DataFrame:
    """Metadata of every path; content columns are never touched."""
    rows = mask_tombstones(files.select("vault_id", "path", "rev", "seq", "hash", "size", "kind", "deleted"))
    return rows.select(
        "vault_id", "path", format_etag(F.lit(epoch), F.col("rev")).alias("etag"), "seq", "hash", "size", "kind", "deleted",
        large_flag(F.col("path"), F.col("kind"), F.col("size"), F.col("deleted")).alias("large"),
    )


def _page(df: DataFrame, order: list[Column], limit: int) -> DataFrame:
    return df.orderBy(*order).limit(limit)


def manifest_page(files: DataFrame, vault_id: str, epoch: str, after: str | None = None, limit: int = K.MANIFEST_PAGE):
    """One page in binary path order and whether another page follows (row ``limit + 1``)."""
    rows = manifest_rows(files.filter(F.col("vault_id") == vault_id), epoch)
    if after is not None:
        rows = rows.filter(F.col("path") > after)
    return _page(rows, [F.col("path")], limit + 1)


def changes_page(changes: DataFrame, vault_id: str, since: int, head_seq: int, limit: int = K.FEED_PAGE) -> DataFrame:
    """Feed rows with ``since < seq <= head_seq``, ascending."""
    rows = changes.filter((F.col("vault_id") == vault_id) & (F.col("seq") > since) & (F.col("seq") <= head_seq))
    return _page(rows, [F.col("seq")], limit)


def history_page(
    revisions: DataFrame, vault_id: str, path: str, epoch: str, after: int = 0, upper: int | None = None,
    limit: int = K.HISTORY_PAGE,
) -> DataFrame:
    """Revisions of one path with ``after < rev <= upper``, ascending, without content."""
    rows = revisions.filter((F.col("vault_id") == vault_id) & (F.col("path") == path) & (F.col("rev") > after))
    if upper is not None:
        rows = rows.filter(F.col("rev") <= upper)
    rows = rows.select(
        "vault_id", "path", "rev", format_etag(F.lit(epoch), F.col("rev")).alias("etag"), "hash", "size", "deleted", "origin", "at_ms"
    )
    return _page(rows, [F.col("rev")], limit + 1)


def list_notes(files: DataFrame, epoch: str, prefix: str | None = None, include_large: bool = False) -> DataFrame:
    """Live Markdown and Canvas files; large ones only on request."""
    return _listing(files, epoch, ("markdown", "canvas"), prefix, include_large)


def list_bases(files: DataFrame, epoch: str, prefix: str | None = None, include_large: bool = False) -> DataFrame:
    """Live Base files."""
    return _listing(files, epoch, ("base",), prefix, include_large)


def _listing(files, epoch, kinds, prefix, include_large):
    live = files.filter(~F.col("deleted") & classify_path(F.col("path")).isin(*kinds))
    if prefix is not None:
        live = live.filter(F.col("path").startswith(prefix))
    big = (F.col("kind") == "blob") & (F.col("size") > K.INLINE_TEXT_LIMIT)
    if not include_large:
        live = live.filter(~big)
    return live.select(
        "vault_id", "path", format_etag(F.lit(epoch), F.col("rev")).alias("etag"), "size", "updated_at", big.alias("large")
    )


def read_notes(requests: DataFrame, files: DataFrame, epoch: str) -> DataFrame:
    """Text slices in UTF-16 units. A stale etag returns the current etag and no content."""
    state = files.select("vault_id", "path", "rev", "kind", "deleted", "content", "size")
    current = format_etag(F.lit(epoch), F.col("rev"))
    joined = requests.join(state, ["vault_id", "path"], "left")
    stale = F.col("etag").isNotNull() & (F.col("etag") != current)
    readable = F.col("rev").isNotNull() & ~F.col("deleted") & (F.col("kind") == "text") & ~F.coalesce(stale, F.lit(False))
    text = F.when(readable, F.col("content"))
    offset = F.coalesce("offset", F.lit(0))
    piece = utf16_slice(text, offset, F.col("length"))
    return joined.select(
        *requests.columns,
        F.when(F.col("rev").isNull(), "not_found").when(F.col("deleted"), "tombstone").when(stale, "stale_etag")
        .when(F.col("kind") != "text", "not_text").alias("reason"),
        F.when(F.col("rev").isNotNull(), current).alias("current_etag"),
        piece.alias("text"),
        F.when(readable, (offset + F.coalesce("length", utf16_length(text))) < utf16_length(text)).alias("truncated"),
    )


def resolve_pinned(requests: DataFrame, revisions: DataFrame, files: DataFrame) -> DataFrame:
    """Content of an exact (path, rev); the current row stands in when it is that revision,
    and ``revision_pruned`` is reported when neither has it."""
    kept = revisions.select("vault_id", "path", "rev", F.col("hash").alias("_rh"), F.col("content").alias("_rc"), F.lit(True).alias("_kept"))
    now = files.select("vault_id", "path", F.col("rev").alias("current_rev"), F.col("hash").alias("_fh"), F.col("content").alias("_fc"))
    same = F.col("current_rev") == F.col("rev")
    return (
        requests.join(kept, ["vault_id", "path", "rev"], "left")
        .join(now, ["vault_id", "path"], "left")
        .select(
            *requests.columns, "current_rev",
            F.when(F.col("_kept"), "revision").when(same, "current").otherwise("revision_pruned").alias("found"),
            F.when(F.col("_kept"), F.col("_rh")).when(same, F.col("_fh")).alias("hash"),
            F.when(F.col("_kept"), F.col("_rc")).when(same, F.col("_fc")).alias("content"),
        )
    )


def rename_target(files: DataFrame) -> DataFrame:
    """Tombstones with their immediate rename destination and its state (one hop only)."""
    gone = files.filter(F.col("deleted") & F.col("renamed_to").isNotNull()).select("vault_id", "path", "rev", "renamed_to")
    there = files.select("vault_id", F.col("path").alias("renamed_to"), F.col("rev").alias("to_rev"), F.col("deleted").alias("to_deleted"))
    return gone.join(there, ["vault_id", "renamed_to"], "left").select("vault_id", "path", "rev", "renamed_to", "to_rev", "to_deleted")


def path_collisions(files: DataFrame) -> DataFrame:
    """Live paths that share a key with another live path. ``min``/``max`` combine map-side;
    only colliding keys are joined back."""
    live = files.filter(~F.col("deleted")).withColumn("path_key", path_key(F.col("path")))
    shared = live.groupBy("vault_id", "path_key").agg(F.min("path").alias("lo"), F.max("path").alias("hi")).filter("lo <> hi")
    return live.join(shared.select("vault_id", "path_key"), ["vault_id", "path_key"], "left_semi").select("vault_id", "path_key", "path")


def vault_summary(files: DataFrame) -> DataFrame:
    """Live and deleted counts, head sequence."""
    return files.groupBy("vault_id").agg(
        F.count_if(~F.col("deleted")).alias("live"), F.count_if(F.col("deleted")).alias("deleted"), F.max("seq").alias("head_seq")
    )


def feed_floor(changes: DataFrame, now_ms: int, pruned: DataFrame | None = None) -> DataFrame:
    """Lowest readable sequence per vault. Past expired rows it never falls back."""
    cutoff = now_ms - K.RETENTION_DAYS * K.DAY_MS
    fresh = F.col("at_ms") >= cutoff
    edges = changes.groupBy("vault_id").agg(
        F.min(F.when(fresh, F.col("seq"))).alias("first"), F.max(F.when(~fresh, F.col("seq"))).alias("last"), F.max("seq").alias("head_seq")
    )
    if pruned is None:
        edges = edges.withColumn("pruned_floor", F.lit(0).cast("long"))
    else:
        edges = edges.join(pruned, "vault_id", "left")
    zero = F.lit(0).cast("long")
    return edges.select(
        "vault_id", "head_seq",
        F.greatest(F.coalesce("first", zero), F.coalesce(F.col("last") + 1, zero), F.coalesce("pruned_floor", zero)).alias("floor"),
    )


def expired_cursors(cursors: DataFrame, floors: DataFrame) -> DataFrame:
    """``cursor_expired`` when ``since < floor - 1``; such a device must reconcile."""
    return cursors.join(floors, "vault_id").select(
        *cursors.columns, "floor",
        F.when(F.col("since") < F.col("floor") - 1, "cursor_expired").alias("reason"),
    )


