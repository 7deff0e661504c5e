"""Fixed values. They decide results, so they are stated here once, as plain text."""

DAY_MS = 86_400_000

# Size limits in bytes.
INLINE_TEXT_LIMIT = 1_000_000
BLOB_LIMIT = 25_000_000

# Path limits.
PATH_BYTES = 512
PATH_SEGMENTS = 32

# Page sizes.
MANIFEST_PAGE = 256
FEED_PAGE = 1_000
HISTORY_PAGE = 256
SEARCH_DEFAULT = 20
SEARCH_MAX = 50

# Capacity limits and alert levels.
LIVE_FILE_LIMIT = 10_000
DATABASE_LIMIT_BYTES = 2_000_000_000
DATABASE_ALERT_BYTES = 1_500_000_000
BLOB_ALERT_BYTES = 4_000_000_000
HISTORY_PRESSURE_LIMIT_BYTES = 1_000_000_000

# Retention and idempotency windows.
RETENTION_DAYS = 30
PRESSURE_FLOOR_DAYS = 7
KEY_PAST_MS = 25 * DAY_MS
KEY_FUTURE_MS = 5 * 60_000

# Metric bounds.
MAX_DAILY_CLIENTS = 128
MAX_DAILY_SAMPLES = 2_048
METRICS_STALE_MS = 10 * 60_000

# BM25 parameters of the published formula.
BM25_K1 = 1.2
BM25_B = 0.75
BM25_MIN_IDF = 1e-6

# Client registry ages.
STALE_CLIENT_AGE_MS = DAY_MS
CONSENT_TTL_MS = 10 * 60_000

# Admission limits.
CLIENT_TICKETS = 16
VAULT_TICKETS = 1_024

SAFE_INTEGER = 2**53 - 1

# Attachment extensions admitted as blobs.
ATTACHMENT_EXTENSIONS = [
    "png", "jpg", "jpeg", "gif", "webp", "svg", "pdf", "mp3",
    "m4a", "wav", "mp4", "mov", "webm", "json", "csv", "txt",
]

# Note-application settings folder and its known files.
SETTINGS_DIR = ".obsidian"
CORE_SETTINGS = ["app.json", "core-plugins.json", "hotkeys.json", "types.json"]
PLUGIN_FILES = ["manifest.json", "main.js", "styles.css", "data.json"]

# Required scope per operation.
REQUIRED_SCOPE = {
    "read": "vault:read",
    "put": "vault:write",
    "rename": "vault:write",
    "append": "vault:write",
    "restore": "vault:write",
    "delete": "vault:delete",
}

# Failure codes with status and message.
FAILURES = [
    ("invalid_request", 400, "The request is not valid."),
    ("query_too_short", 400, "The search query is too short."),
    ("query_too_long", 400, "The search query is too long."),
    ("invalid_path", 400, "The path is not valid."),
    ("revoked", 401, "The grant no longer allows access."),
    ("forbidden_scope", 403, "The grant does not allow this operation."),
    ("not_found", 404, "The file does not exist."),
    ("epoch_mismatch", 409, "The vault epoch does not match."),
    ("path_collision", 409, "Another file uses this path key."),
    ("operation_expired", 409, "The operation key is outside the accepted time range."),
    ("capacity_exceeded", 507, "The vault has reached its storage limit."),
    ("idempotency_in_progress", 409, "An operation with this key is not complete."),
    ("invalid_ticket", 409, "The operation ticket is not valid."),
    ("revision_pruned", 410, "This revision is no longer available."),
    ("cursor_expired", 410, "This read cursor is no longer valid."),
    ("precondition_failed", 412, "The file state does not match the precondition."),
    ("text_too_large", 413, "The text is larger than the size limit."),
    ("blob_too_large", 413, "The blob is larger than the size limit."),
    ("blob_integrity_mismatch", 422, "The blob does not match its declared identity."),
    ("blob_storage_unavailable", 503, "Blob storage cannot verify this request now."),
    ("blob_gc_in_progress", 503, "Blob collection changed. Retry the operation."),
    ("idempotency_mismatch", 422, "This key belongs to a different operation."),
    ("admission_limited", 429, "The vault cannot accept another operation now."),
    ("not_implemented", 501, "The service does not support this operation."),
    ("tombstone", 409, "The path is deleted."),
    ("path_occupied", 409, "The destination path is occupied."),
    ("idempotency_key_required", 428, "The idempotency key is required."),
    ("unsupported_append_kind", 415, "The file kind does not support append."),
    ("heading_not_found", 404, "The requested heading does not exist in the note."),
    ("unauthorized", 401, "Authentication is not valid."),
    ("internal_error", 500, "The service cannot complete the request."),
    ("importing", 503, "The vault is still importing."),
    ("vault_retired", 410, "The vault has moved to a new identity."),
]
