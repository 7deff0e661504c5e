"""Client registry: grants, revocation fence, stale and removable registrations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K



def _with_denial(grants: DataFrame, revoked: DataFrame) -> DataFrame:
    denied = revoked.select("grant_id", F.lit(True).alias("_denied")).distinct()
    return grants.join(denied, "grant_id", "left").withColumn("active", F.col("_denied").isNull()).drop("_denied")


def client_registry(clients: DataFrame, grants: DataFrame, revoked: DataFrame) -> DataFrame:
    """Clients with retained, active and cleanup-pending grants; ``position`` sorts active first."""
    counts = _with_denial(grants, revoked).groupBy("client_id").agg(
        F.count(F.lit(1)).alias("grant_count"), F.count_if("active").alias("active_grant_count"),
        F.count_if("cleanup_pending").alias("cleanup_pending"),
    )
    out = clients.join(counts, "client_id", "left").na.fill(0, ["grant_count", "active_grant_count", "cleanup_pending"])
    position = F.when(F.col("active_grant_count") > 0, 0).when(F.col("grant_count") == 0, 1).otherwise(2)
    return out.withColumn("position", position)


def revoke_clients(target, clients, grants, revoked, consents, now_ms: int) -> dict[str, DataFrame]:
    """Registry after revoking ``target``: generation + 1, all grants denied, consents void."""
    chosen = target.select("client_id").distinct().withColumn("_hit", F.lit(True))

    def flag(df):
        return df.join(chosen, "client_id", "left").withColumn("_hit", F.coalesce("_hit", F.lit(False)))

    held = flag(_with_denial(grants, revoked))
    newly = held.filter("_hit and active").select("grant_id", F.lit(now_ms).cast("long").alias("at_ms"))
    return {
        "clients": flag(clients).withColumn("generation", F.col("generation") + F.col("_hit").cast("long")).drop("_hit"),
        "grants": held.withColumn("cleanup_pending", F.col("cleanup_pending") | (F.col("_hit") & F.col("active"))).drop("_hit", "active"),
        "revoked": revoked.unionByName(newly),
        "consents": consents.join(chosen.select("client_id"), "client_id", "left_anti"),
    }


def stale_clients(clients: DataFrame, grants: DataFrame, consents: DataFrame, now_ms: int) -> DataFrame:
    """Registrations older than a day with no grant and no consent of the last ten minutes."""
    old = clients.filter(F.col("created_at") < now_ms - K.STALE_CLIENT_AGE_MS)
    recent = consents.filter(F.col("created_at") > now_ms - K.CONSENT_TTL_MS).select("client_id")
    return (
        old.join(grants.select("client_id"), "client_id", "left_anti")
        .join(recent, "client_id", "left_anti")
        .select("vault_id", "client_id")
    )


def removable_clients(clients: DataFrame, grants: DataFrame, revoked: DataFrame) -> DataFrame:
    """Revoked registrations whose grants are all denied and cleaned up."""
    busy = _with_denial(grants, revoked).filter("active or cleanup_pending").select("client_id")
    return clients.filter("generation > 0").join(busy, "client_id", "left_anti").select("vault_id", "client_id")
