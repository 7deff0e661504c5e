"""Equal-volume cut points of sorted rows, from a quantile sketch that merges.

A summary is a sorted list of (key, weight): the weight is that of the rows above the key before, up to and with this key.
Each task sums up its rows, summaries are merged group by group in a tree and cut back to ``POINTS`` entries at each level,
so neither a task nor the driver ever holds more than a bounded number of entries. A level moves a cut by at most a
``POINTS``-th of the weight that it saw. Cut points decide balance, never results.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINTS = 1_024  # entries of a summary
FAN_IN = 64  # summaries merged by one task
_SUMMARY = "key binary, weight long"
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)


def sort_key(columns: list[tuple[Column, T.DataType]]) -> Column:
    """Bytes that sort as the columns do, NULLs first; for whole numbers, booleans, strings and binaries."""
    parts = []
    for column, kind in columns:
        if isinstance(kind, _WHOLE):
            value = F.unhex(F.lpad(F.hex(column.cast("int").cast("long") if isinstance(kind, T.BooleanType) else column.cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"))
        elif isinstance(kind, T.StringType):
            # A zero byte inside is told from the end by what follows it.
            value = F.concat(F.encode(F.replace(column, F.lit("\0"), F.lit("\0\x01")), "UTF-8"), F.lit(b"\0\0"))
        else:
            raise TypeError(f"no sort key for {kind.simpleString()}")
        parts.append(F.coalesce(F.concat(F.lit(b"\x01"), value), F.lit(b"\0")))
    return F.concat(*parts)


def row_bytes(df: DataFrame) -> Column:
    """Measured size of a row: lengths of its strings and binaries, fixed widths for the rest."""
    fixed, measured = 16, F.lit(0).cast("long")
    for field in df.schema.fields:
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            measured = measured + F.coalesce(F.octet_length(F.col(field.name)), F.lit(0))
            fixed += 16
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            measured = measured + F.coalesce(F.octet_length(F.to_json(F.struct(F.col(field.name)))), F.lit(0))
            fixed += 16
        else:
            fixed += 8
    return measured + F.lit(fixed).cast("long")


def compress(keys: list[bytes], weights: np.ndarray, points: int) -> tuple[list[bytes], np.ndarray]:
    """Sorted entries cut back to about ``points``, each with the weight up to it; the last key always stays."""
    if len(keys) <= points:
        return keys, weights
    sums = np.cumsum(weights)
    at = np.unique(np.searchsorted(sums, np.arange(1, points + 1) * (int(sums[-1]) / points)).clip(0, len(keys) - 1))
    at = np.unique(np.r_[at, len(keys) - 1])
    return [keys[i] for i in at], np.diff(np.r_[0, sums[at]])


def merge(left, right, points: int):
    """Summary of two summaries."""
    keys = [*left[0], *right[0]]
    weights = np.r_[left[1], right[1]]
    order = sorted(range(len(keys)), key=keys.__getitem__)
    return compress([keys[i] for i in order], weights[order], points)


def _summarize(points: int):
    """One summary of all rows of a task, which are rows or earlier summaries."""

    def summarize(batches):
        found = ([], np.zeros(0, np.int64))
        for batch in batches:
            if batch.num_rows:
                rows = pa.table({"key": batch.column("key"), "weight": batch.column("weight")}).sort_by("key")
                rows = rows.column("key").to_pylist(), rows.column("weight").to_numpy().astype(np.int64)
                # Four times the points inside a task, so that many batches cost no precision.
                found = merge(found, compress(*rows, 4 * points), 4 * points)
        keys, weights = compress(*found, points)
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(weights, pa.int64())], ["key", "weight"])

    return summarize


def cut_points(rows: DataFrame, slices: int, points: int = POINTS, fan_in: int = FAN_IN) -> list[bytes]:
    """At most ``slices - 1`` keys that cut rows (key, weight) into slices of about equal weight.

    A slice holds the keys above the cut before and up to its own.
    """
    points = max(points, 4 * slices)
    found = rows.mapInArrow(_summarize(points), _SUMMARY)
    tasks = rows.rdd.getNumPartitions()
    while tasks > fan_in:
        tasks = -(-tasks // fan_in)
        # Whole summaries move together: a task's entries share the number of its group.
        grouped = found.withColumn("_group", F.spark_partition_id() % tasks)
        found = grouped.repartition(tasks, "_group").drop("_group").mapInArrow(_summarize(points), _SUMMARY)
    pairs = [(bytes(r.key), r.weight) for r in found.collect()]  # at most fan_in summaries
    pairs.sort()
    sums = np.cumsum([w for _, w in pairs]) if pairs else np.zeros(0)
    cuts = []
    for i in range(1, slices):
        at = int(np.searchsorted(sums, sums[-1] * i / slices)) if len(sums) else 0
        if at + 1 < len(pairs):
            cuts.append(pairs[at][0])
    return sorted(set(cuts))


def slice_of(key: Column, cuts: list[bytes]) -> Column:
    """Number of a key's slice, looked up where the row is."""
    if not cuts:
        return F.lit(0)

    @F.pandas_udf("int")
    def look_up(keys: pd.Series) -> pd.Series:
        return pd.Series([bisect_left(cuts, k) for k in keys], dtype="int32")

    return look_up(key)
