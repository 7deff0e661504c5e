"""Session helpers: lineage cuts and scans over hot keys that hold on a cluster."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .quantiles import cut_points, row_bytes, slice_of, sort_key

# Volume of one slice of a running sum.
SLICE_BYTES = 256 * 1024 * 1024


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings the operators rely on: UTC, adaptive plans, and no partitioning taken
    over from a union's inputs (with adaptive local reads that has dropped needed shuffles)."""
    for key, value in {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.unionOutputPartitioning": "false",
    }.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared ``spark.checkpoint.dir``, else a folder below the shared warehouse."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    spark.sparkContext.setCheckpointDir(shared or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the reliable checkpoint folder and read it from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def written_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder and read it back, as a step's table that later steps read often."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Give CPU-heavy work on a small input enough tasks.

    Only an input below one full split per core is moved; a large one already has more
    splits than cores and is returned as it is, without a shuffle.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * 128 * 1024 * 1024 else df


def prefix_scan(
    df: DataFrame,
    keys: list[str],
    order: list[str | Column],
    sums: dict[str, Column],
    exclusive: bool = False,
    finer: dict[str, list[str]] | None = None,
    slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """Running sums per key in sort order, without one task per key.

    The rows are written down once and their bytes measured on the way. Their number of slices follows from these
    bytes, and slices of equal volume from a quantile sketch over ``keys + order``; each row finds its slice
    where it is. Totals per slice give offsets, and the windows run inside ``(slice, key)`` only, so one hot key
    spreads over as many tasks as its volume asks for. ``order`` must be unique within a key. ``finer`` names sums that run per
    further columns, in the same slices.
    """
    finer = finer or {}
    ordered = [F.col(c) if isinstance(c, str) else c for c in order]
    df = df.withColumns({name: value.cast("long") for name, value in sums.items()})
    places = df.select(*[F.col(k) for k in keys], *[c.alias(f"_{i}") for i, c in enumerate(ordered)]).schema.fields
    key = sort_key([(c, f.dataType) for c, f in zip([*[F.col(k) for k in keys], *ordered], places)])
    seen = Observation()
    rows = cut_lineage(df.withColumns({"_key": key, "_bytes": row_bytes(df)}).observe(seen, F.sum("_bytes").alias("volume")))
    slices = max(-(-(seen.get["volume"] or 0) // slice_bytes), 1)
    cuts = cut_points(rows.select(F.col("_key").alias("key"), F.col("_bytes").alias("weight")), slices) if slices > 1 else []
    sliced = rows.withColumn("_slice", slice_of(F.col("_key"), cuts)).drop("_key", "_bytes")
    out, end = sliced, -1 if exclusive else Window.currentRow
    for group in dict.fromkeys(tuple([*keys, *finer.get(n, [])]) for n in sums):
        own = [n for n in sums if tuple([*keys, *finer.get(n, [])]) == group]
        inside = Window.partitionBy("_slice", *group).orderBy(*ordered).rowsBetween(Window.unboundedPreceding, end)
        out = out.withColumns({f"_r_{n}": F.coalesce(F.sum(n).over(inside), F.lit(0)) for n in own})
        if cuts:
            totals = sliced.groupBy(*group, "_slice").agg(*[F.sum(n).alias(f"_t_{n}") for n in own])
            before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
            offsets = totals.select(
                *[F.col(c).alias(f"_g_{c}") for c in group], F.col("_slice").alias("_g_slice"),
                *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in own],
            )
            same = [out[c].eqNullSafe(offsets[f"_g_{c}"]) for c in group] + [out["_slice"] == offsets["_g_slice"]]
            out = out.join(offsets, same).withColumns({f"_r_{n}": F.col(f"_r_{n}") + F.col(f"_o_{n}") for n in own})
            out = out.drop(*[f"_g_{c}" for c in group], "_g_slice", *[f"_o_{n}" for n in own])
    return out.withColumns({n: F.col(f"_r_{n}") for n in sums}).drop("_slice", *[f"_r_{n}" for n in sums])


def arrival_rank(
    df: DataFrame, keys: list[str], arrival: str, out: str, width: int = 1_000_000
) -> DataFrame:
    """1-based position per key in arrival order; ``arrival`` is a unique integer per key.

    Arrival ranges of ``width`` bound every window task even if one key holds most rows.
    """
    slot = F.floor(F.col(arrival) / F.lit(width)).cast("long")
    slotted = df.withColumn("_slot", slot)
    counts = slotted.groupBy(*keys, "_slot").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *keys, "_slot", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    inside = Window.partitionBy(*keys, "_slot").orderBy(arrival)
    return (
        slotted.join(offsets, [*keys, "_slot"])
        .withColumn(out, (F.row_number().over(inside) + F.col("_offset")).cast("long"))
        .drop("_slot", "_offset")
    )


def neighbour(
    df: DataFrame, keys: list[str], arrival: str, value: Column, out: str, forward: bool, width: int = 1_000_000
) -> DataFrame:
    """``value`` of the next (or previous) row per key in arrival order.

    Works inside arrival ranges of ``width``; the edge row of every range is taken from a
    small per-range aggregate, so one hot key is never one window task.
    """
    slotted = df.withColumns({"_slot": F.floor(F.col(arrival) / F.lit(width)).cast("long"), "_value": value})
    pick = F.min_by if forward else F.max_by
    edges = slotted.groupBy(*keys, "_slot").agg(pick("_value", arrival).alias("_edge"))
    step = F.lead if forward else F.lag
    edges = edges.select(*keys, "_slot", step("_edge").over(Window.partitionBy(*keys).orderBy("_slot")).alias("_beyond"))
    inside = Window.partitionBy(*keys, "_slot").orderBy(arrival)
    near = slotted.withColumns(
        {"_near": step("_value").over(inside), "_has": step(F.lit(True)).over(inside)}
    )
    return near.join(edges, [*keys, "_slot"]).withColumn(
        out, F.when(F.col("_has"), F.col("_near")).otherwise(F.col("_beyond"))
    ).drop("_slot", "_value", "_near", "_has", "_beyond")
