"""Content-addressed blobs: ingest, publication checks, range reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K


def ingest_blobs(uploads: DataFrame, existing: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Create-only put of ``content`` under its hash → (new blobs, rejected uploads).

    ``declared_hash`` and ``declared_size`` must match the bytes. Copies of one blob
    collapse by a two-step aggregate, so one popular blob does not load one task.
    """
    measured = uploads.withColumns(
        {"hash": F.sha2("content", 256), "size": F.octet_length("content").cast("long")}
    ).withColumn(
        "reason",
        F.when((F.col("declared_size") > K.BLOB_LIMIT) | (F.col("size") > K.BLOB_LIMIT), "blob_too_large").when(
            (F.col("hash") != F.col("declared_hash")) | (F.col("size") != F.col("declared_size")), "blob_integrity_mismatch"
        ),
    )
    good = measured.filter(F.col("reason").isNull())
    if existing is not None:
        good = good.join(existing.select("vault_id", "hash"), ["vault_id", "hash"], "left_anti")
    fresh = good.groupBy("vault_id", "hash").agg(F.min("size").alias("size"), F.min("at_ms").alias("first_ref_at"),
                                                 F.any_value("content").alias("content"))
    return fresh, measured.filter(F.col("reason").isNotNull())


def check_blob_puts(puts: DataFrame, registry: DataFrame, marks: DataFrame) -> DataFrame:
    """Blob publications against the registered size and the collection fence."""
    known = registry.select("vault_id", F.col("hash").alias("payload_hash"), F.col("size").alias("_size"))
    fenced = marks.select("vault_id", F.col("hash").alias("payload_hash"), F.lit(True).alias("_marked")).distinct()
    return (
        puts.join(known, ["vault_id", "payload_hash"], "left")
        .join(fenced, ["vault_id", "payload_hash"], "left")
        .withColumn(
            "reason",
            F.when(F.col("_size") != F.col("size"), "blob_integrity_mismatch").when(F.col("_marked"), "blob_gc_in_progress"),
        )
        .drop("_size", "_marked")
    )


def verify_blob_bytes(
    blobs: DataFrame, expected: DataFrame, start: int = 0, length: int | None = None, max_length: int | None = None
) -> DataFrame:
    """Whole or range read of blob bytes, checked against hash and size first.

    A range gives all that was asked for; one longer than ``max_length`` (off unless given) is refused.
    """
    whole = F.col("content")
    part = whole if start == 0 and length is None else F.substring(whole, start + 1, 2**31 - 1 if length is None else length)
    refused = F.lit(max_length is not None and length is not None and length > max_length)
    return (
        expected.select("vault_id", "hash", F.col("size").alias("expected_size")).distinct()
        .join(blobs, ["vault_id", "hash"], "left")
        .withColumn("actual_hash", F.sha2("content", 256))
        .select(
            "vault_id", "hash",
            F.when(refused, "invalid_request").when(F.col("content").isNull(), "blob_storage_unavailable")
            .when((F.col("actual_hash") != F.col("hash")) | (F.octet_length("content") != F.col("expected_size")), "blob_integrity_mismatch")
            .alias("reason"),
            part.alias("bytes"),
        )
        .withColumn("bytes", F.when(F.col("reason").isNull(), F.col("bytes")))
    )
