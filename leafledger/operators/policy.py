"""Who may do what: revocation, scope and epoch checks, failure details."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.identity import format_etag



def required_scope(op: str = "op"):
    scopes = F.create_map(*[F.lit(x) for pair in K.REQUIRED_SCOPE.items() for x in pair])
    return F.try_element_at(scopes, F.col(op))


def authorize_ops(ops: DataFrame, vault_state: DataFrame, revoked_grants: DataFrame) -> DataFrame:
    """Adds ``reason``: ``revoked``, then ``forbidden_scope``, then ``epoch_mismatch``.

    ``ops`` carries ``grant_id``, ``scopes``, ``epoch`` (explicit, may be NULL) and
    ``match_epoch`` (from the ETag, may be NULL). One state row per vault, one row per grant.
    """
    denied = revoked_grants.select("grant_id", F.lit(True).alias("_denied")).distinct()
    current = vault_state.select("vault_id", F.col("epoch").alias("current_epoch"))
    seen = F.coalesce("epoch", "match_epoch")
    return (
        ops.join(denied, "grant_id", "left")
        .join(current, "vault_id", "left")
        .withColumn(
            "reason",
            F.when(F.col("_denied"), "revoked")
            .when(~F.array_contains("scopes", required_scope()), "forbidden_scope")
            .when(F.col("current_epoch").isNull() | (seen != F.col("current_epoch")), "epoch_mismatch"),
        )
        .drop("_denied")
    )


def failure_codes(spark) -> DataFrame:
    """The closed list of failure codes with status and message."""
    return spark.createDataFrame(K.FAILURES, "reason string, status int, message string")


def explain_failures(rejected: DataFrame) -> DataFrame:
    """Adds status, message and the detail fields that the code allows.

    Current content appears only in a failed precondition, only for a reader, only if live.
    """
    codes = F.broadcast(failure_codes(rejected.sparkSession))  # 33 fixed rows
    failed = F.col("reason") == "precondition_failed"
    known = failed & F.col("current_rev").isNotNull()
    may_read = F.array_contains("scopes", "vault:read")
    return rejected.join(codes, "reason", "left").withColumns(
        {
            "detail_etag": F.when(known, format_etag(F.col("current_epoch"), F.col("current_rev"))),
            "detail_hash": F.when(known, F.col("current_hash")),
            "detail_deleted": F.when(known, F.col("current_deleted")),
            "detail_renamed_to": F.when(known & F.col("current_deleted"), F.col("current_renamed_to")),
            "detail_content": F.when(known & may_read & ~F.col("current_deleted"), F.col("current_content")),
        }
    )
