"""Path rules: normal form, file kind, storage route, enrollment scope, copy names."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from .unicode import nfc, path_key

_CONTROL = "[\\\\\\x00-\\x1F\\x7F-\\x9F]"


def is_valid_path(path: Column) -> Column:
    """Checks on an NFC path. One split-free regex covers empty and dot segments."""
    bad_segment = path.rlike(r"(^|/)(\.{0,2})(/|$)")
    slashes = F.char_length(path) - F.char_length(F.replace(path, F.lit("/"), F.lit("")))
    return (
        (F.octet_length(path) <= K.PATH_BYTES)
        & (slashes < K.PATH_SEGMENTS)
        & ~bad_segment
        & ~path.rlike(_CONTROL)
    )


def normalize_paths(df: DataFrame, column: str = "path") -> DataFrame:
    """Adds ``norm_path`` (NFC), ``path_key`` and ``reason`` (NULL or ``invalid_path``)."""
    normal = df.withColumn("norm_path", nfc(F.col(column)))
    valid = F.coalesce(is_valid_path(F.col("norm_path")), F.lit(False))
    return normal.select(
        *df.columns,
        F.when(valid, F.col("norm_path")).alias("norm_path"),
        F.when(valid, F.lower("norm_path")).alias("path_key"),
        F.when(~valid, F.lit("invalid_path")).alias("reason"),
    )


def _ends(path: Column, suffix: str) -> Column:
    return F.lower(F.right(path, F.lit(len(suffix)))) == suffix


def classify_path(path: Column) -> Column:
    """``markdown``, ``canvas``, ``base`` or ``other`` by the final extension."""
    return (
        F.when(_ends(path, ".md"), "markdown")
        .when(_ends(path, ".canvas"), "canvas")
        .when(_ends(path, ".base"), "base")
        .otherwise("other")
    )


def storage_kind(path: Column, size: Column) -> Column:
    """``text``, ``blob`` or ``blob_too_large``."""
    known = classify_path(path) != "other"
    return (
        F.when(known & (size <= K.INLINE_TEXT_LIMIT), "text")
        .when(size <= K.BLOB_LIMIT, "blob")
        .otherwise("blob_too_large")
    )


def large_flag(path: Column, kind: Column, size: Column, deleted: Column) -> Column:
    """A live Markdown or Canvas blob above the inline limit (never a Base)."""
    return (
        ~deleted
        & (kind == "blob")
        & (size > K.INLINE_TEXT_LIMIT)
        & classify_path(path).isin("markdown", "canvas")
    )


def placeholder_source(path: Column) -> Column:
    """``dir/.name.icloud`` stands for ``dir/name``; NULL for any other path."""
    return F.when(
        path.rlike(r"[^/]\.icloud$") & ~path.rlike(r"(^|/)\.\.icloud$"),
        F.regexp_replace(F.regexp_replace(path, r"\.icloud$", ""), r"(^|/)\.([^/]+)$", "$1$2"),
    )


@dataclass(frozen=True)
class ScopePolicy:
    """Per-device choice. ``private_dir`` and ``private_plugin`` are the names that the
    running sync product reserves for itself; they are configuration, not rules."""

    enabled: bool = False
    appearance: bool = True
    core: bool = True
    community_plugins: bool = True
    private_dir: str = ".vault-sync"
    private_plugin: str = "vault-sync"
    conflict_dir: str = "Settings conflicts/"


DEFAULT_POLICY = ScopePolicy()


def settings_category(segments: Column) -> Column:
    """Category of a path below the settings folder, or NULL. ``segments`` is the split key."""
    first, second, third = (F.get(segments, F.lit(i)) for i in (1, 2, 3))
    depth = F.size(segments)
    return (
        F.when((depth == 2) & (first == "appearance.json"), "appearance")
        .when((depth == 2) & (first == "community-plugins.json"), "community_plugins")
        .when((depth == 2) & first.isin(K.CORE_SETTINGS), "core")
        .when(first.isin("themes", "snippets") & (depth > 2), "appearance")
        .when((first == "plugins") & (depth == 4) & third.isin(K.PLUGIN_FILES), "community_plugins")
    )


def settings_excluded(segments: Column, policy: ScopePolicy) -> Column:
    first = F.get(segments, F.lit(1))
    return (
        first.rlike(r"^workspace.*\.json$")
        | (first == "graph.json")
        | first.startswith("cache")
        | ((first == "plugins") & F.coalesce(F.get(segments, F.lit(2)) == policy.private_plugin, F.lit(False)))
        | F.array_contains(F.slice(segments, 2, K.PATH_SEGMENTS), "node_modules")
    )


def enrollment_scope(path: Column, size: Column, policy: ScopePolicy = DEFAULT_POLICY) -> Column:
    """``text``, ``blob``, ``excluded`` or ``unsupported`` for one NFC path."""
    key = F.lower(path)
    segments = F.split(key, "/")
    top = F.get(segments, F.lit(0))
    name = F.element_at(segments, -1)
    category = settings_category(segments)
    switches = {"appearance": policy.appearance, "core": policy.core, "community_plugins": policy.community_plugins}
    on = [c for c, enabled in switches.items() if enabled and policy.enabled]
    blob = F.when(size > K.BLOB_LIMIT, "unsupported").otherwise("blob")
    settings = F.when(
        F.coalesce(category.isin(on) if on else F.lit(False), F.lit(False)) & ~settings_excluded(segments, policy), blob
    ).otherwise("excluded")
    extension = F.regexp_extract(key, r"([^.]*)$", 1)
    return (
        F.when(
            path.isNull() | size.isNull() | ~is_valid_path(path) | ~size.between(0, K.SAFE_INTEGER),
            "excluded",
        )
        .when(top.isin(".trash", policy.private_dir) | (name == ".ds_store") | name.endswith(".icloud"), "excluded")
        .when(top == K.SETTINGS_DIR, settings)
        .when(
            classify_path(path) != "other",
            F.when(size > K.BLOB_LIMIT, "unsupported").when(size <= K.INLINE_TEXT_LIMIT, "text").otherwise("blob"),
        )
        .when(extension.isin(K.ATTACHMENT_EXTENSIONS), blob)
        .otherwise("excluded")
    )


def _file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def conflict_name(
    path: Column, device: Column | str, rev: Column, at_ms: Column, policy: ScopePolicy = DEFAULT_POLICY
) -> Column:
    """``<stem> (conflict <device> <YYYY-MM-DD HHmm> r<rev>)<ext>`` beside the original.

    Settings paths are flattened into one visible folder and get a supported extension.
    """
    device = F.lit(device) if isinstance(device, str) else device
    settings = F.lower(path).startswith(K.SETTINGS_DIR + "/")
    flat = F.replace(F.regexp_replace(path, r"^[^/]*/", ""), F.lit("/"), F.lit(" — "))
    name = F.when(settings, flat).otherwise(_file_name(path))
    folder = F.when(settings, F.lit(policy.conflict_dir)).otherwise(F.regexp_replace(path, r"[^/]*$", ""))
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    source_ext = F.substring(name, F.char_length(stem) + 1, F.char_length(name))
    supported = classify_path(source_ext) != "other"
    attachment = F.lower(F.regexp_extract(source_ext, r"([^.]*)$", 1)).isin(K.ATTACHMENT_EXTENSIONS)
    ext = F.when(settings & ~(supported | attachment), F.concat(source_ext, F.lit(".txt"))).otherwise(source_ext)
    minute = F.date_format(F.timestamp_millis(at_ms), "yyyy-MM-dd HHmm")
    safe = F.regexp_replace(F.trim(device), r'[\x00-\x1F\x7F-\x9F\\/:*?"<>|]', "_")
    return F.concat(
        folder, stem, F.lit(" (conflict "), safe, F.lit(" "), minute, F.lit(" r"), rev.cast("string"), F.lit(")"), ext
    )


def recovery_name(conflict: Column, content_hash: Column) -> Column:
    """Copy name for one more byte state: `` (recovery <16 hex>)`` before the extension,
    the stem cut to whole characters so that the path fits 512 bytes; NULL if none is left."""
    folder = F.regexp_replace(conflict, r"[^/]*$", "")
    name = _file_name(conflict)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    ext = F.substring(name, F.char_length(stem) + 1, F.char_length(name))
    suffix = F.concat(F.lit(" (recovery "), F.left(content_hash, F.lit(16)), F.lit(")"))
    room = F.lit(K.PATH_BYTES) - F.octet_length(F.concat(folder, suffix, ext))
    raw = F.encode(stem, "UTF-8")
    # The cut may split one character: of the last four lengths, the longest valid one is it.
    fits = [F.try_validate_utf8(F.substring(raw, F.lit(1), (room - k).cast("int")).cast("string")) for k in range(4)]
    kept = F.when(F.octet_length(stem) <= room, stem).otherwise(F.coalesce(*fits))
    return F.when((room >= 1) & (F.char_length(kept) > 0), F.concat(folder, kept, suffix, ext))


def ancestors(path: Column) -> Column:
    """Every folder above ``path``, nearest last; empty for a top-level file."""
    parts = F.split(path, "/")
    return F.when(
        F.size(parts) > 1,
        F.transform(
            F.sequence(F.lit(1), F.size(parts) - 1),
            lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"),
        ),
    ).otherwise(F.array().cast("array<string>"))


__all__ = [
    "ScopePolicy", "ancestors", "classify_path", "conflict_name", "enrollment_scope", "is_valid_path",
    "large_flag", "nfc", "normalize_paths", "path_key", "placeholder_source", "recovery_name",
    "settings_category", "storage_kind",
]
