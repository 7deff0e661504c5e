"""Hashes, ETags, operation fingerprints, JSON row text, UUIDv7 keys and UTC days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K


def sha256(value: Column) -> Column:
    return F.sha2(value, 256)


def format_etag(epoch: Column, rev: Column) -> Column:
    return F.concat(F.lit('"'), epoch, F.lit("."), rev.cast("string"), F.lit('"'))


_ETAG = r'^"([0-9a-f]{32})\.([1-9][0-9]*)"$'


def etag_epoch(etag: Column) -> Column:
    return F.nullif(F.regexp_extract(etag, _ETAG, 1), F.lit(""))


def etag_rev(etag: Column) -> Column:
    return F.nullif(F.regexp_extract(etag, _ETAG, 2), F.lit("")).cast("long")


def json_string(value: Column) -> Column:
    """One value as JSON text: escaped, quoted, ``null`` for NULL."""
    wrapped = F.to_json(F.struct(value.alias("v")))
    body = F.substring(wrapped, F.lit(6), F.char_length(wrapped) - 6)
    return F.coalesce(F.when(value.isNotNull(), body), F.lit("null"))


def json_number(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("null"))


def json_row(*parts: Column) -> Column:
    """JSON array text of already encoded parts, in the order given."""
    return F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]"))


def precondition_json(kind: Column, epoch: Column, rev: Column) -> Column:
    matched = F.concat(
        F.lit('{"kind":"match","etag":'), json_string(format_etag(epoch, rev)), F.lit("}")
    )
    return F.when(kind == "match", matched).otherwise(F.concat(F.lit('{"kind":"'), kind, F.lit('"}')))


def op_fingerprint(
    epoch: Column, client_id: Column, op: Column, paths: list[Column], precondition: Column,
    payload_hash: Column, size: Column,
) -> Column:
    """SHA-256 of the JSON tuple [1, epoch, client, op, paths, precondition, hash, size]."""
    quoted = [F.when(p.isNotNull(), json_string(p)) for p in paths]
    return sha256(
        json_row(
            F.lit("1"), json_string(epoch), json_string(client_id), json_string(op), json_row(*quoted),
            precondition, json_string(payload_hash), json_number(size),
        )
    )


def command_identity(
    op: Column, to: Column, source_rev: Column, as_copy: Column, heading: Column, content: Column
) -> Column:
    """Bytes that name a command: rename, restore and heading append as JSON, append as is."""
    return (
        F.when(op == "rename", F.concat(F.lit('{"to":'), json_string(to), F.lit("}")))
        .when(
            op == "restore",
            F.concat(
                F.lit('{"source_rev":'), json_number(source_rev), F.lit(',"as_conflict_copy":'),
                F.coalesce(as_copy, F.lit(False)).cast("string"), F.lit("}"),
            ),
        )
        .when(
            heading.isNotNull(),
            F.concat(F.lit('{"heading":'), json_string(heading), F.lit(',"content":'), json_string(content), F.lit("}")),
        )
        .otherwise(content)
    )


_UUID7 = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-7[0-9a-fA-F]{3}-[89abAB][0-9a-fA-F]{3}-[0-9a-fA-F]{12}$"


def uuid7_ms(key: Column) -> Column:
    """Unix milliseconds inside a UUIDv7; NULL for any other string."""
    digits = F.substring(F.replace(key, F.lit("-"), F.lit("")), 1, 12)
    return F.when(key.rlike(_UUID7), F.conv(digits, 16, 10).cast("long"))


def uuid7_from(at_ms: Column, entropy: Column) -> Column:
    """A UUIDv7 for ``at_ms`` whose random bits come from the hex string ``entropy``
    (at least 32 digits), so a retried task writes the same key again."""
    time = F.lpad(F.lower(F.hex(at_ms)), 12, "0")
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(entropy, 4, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat_ws(
        "-", F.substring(time, 1, 8), F.substring(time, 9, 4), F.concat(F.lit("7"), F.substring(entropy, 1, 3)),
        F.concat(variant, F.substring(entropy, 5, 3)), F.substring(entropy, 8, 12),
    )


def key_window(key: Column, now_ms: Column | int) -> Column:
    """True if the key may start a new operation: opaque, or 25 days back to 5 minutes ahead."""
    now = F.lit(now_ms) if isinstance(now_ms, int) else now_ms
    made = uuid7_ms(key)
    return made.isNull() | made.between(now - F.lit(K.KEY_PAST_MS), now + F.lit(K.KEY_FUTURE_MS))


def utc_day(at_ms: Column) -> Column:
    """UTC midnight in milliseconds, session zone independent."""
    return F.floor(at_ms / F.lit(K.DAY_MS)).cast("long") * F.lit(K.DAY_MS)


def safe_integer(value: Column) -> Column:
    return value.between(0, K.SAFE_INTEGER)


def validate_requests(df: DataFrame) -> DataFrame:
    """Bounds of keys (8–128), queries (3–200 code points) and limits (1–50, default 20)."""
    return df.withColumns(
        {
            "key_reason": F.when(~F.char_length("op_key").between(8, 128), "invalid_request"),
            "query_reason": F.when(F.char_length("query") < 3, "query_too_short").when(
                F.char_length("query") > 200, "query_too_long"
            ),
            "result_limit": F.coalesce(F.col("result_limit"), F.lit(K.SEARCH_DEFAULT)),
            "limit_reason": F.when(
                ~F.coalesce(F.col("result_limit"), F.lit(K.SEARCH_DEFAULT)).between(1, K.SEARCH_MAX), "invalid_request"
            ),
        }
    )
