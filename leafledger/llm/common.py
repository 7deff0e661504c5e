"""Helpers shared by the operators: words, Arrow slices, folds and the shared folder."""

from __future__ import annotations

import sys
import types
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A word is a run of other characters than these; bytes.split() uses the same six.
SPACE_CLASS = r"\x20\x09-\x0D"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(value: Column) -> Column:
    """A-Z lowered, every other character as it is."""
    return F.translate(value, UPPER, LOWER)


def word_count(text: Column) -> Column:
    """Number of words of a text; NULL has none."""
    parts = F.split(text, f"[{SPACE_CLASS}]+")
    edges = (F.element_at(parts, 1) == "").cast("int") + ((F.element_at(parts, -1) == "") & (F.size(parts) > 1)).cast("int")
    return F.coalesce((F.size(parts) - edges).cast("long"), F.lit(0).cast("long"))


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's text modulo ``folds``; NULL for a NULL id."""
    return (F.crc32(doc_id.cast("string").cast("binary")) % folds).cast("int")


def fold_of_id(doc_id: int | None, folds: int) -> int:
    """The same in a task; a NULL id is never held out."""
    return folds if doc_id is None else zlib.crc32(str(doc_id).encode()) % folds


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that every executor reaches: below ``spark.checkpoint.dir``, else below the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: a lost executor costs no second run."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def byte_texts(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column."""
    return column.cast(pa.binary()).to_pylist()


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a slice holds at most ``limit`` text bytes, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        start = 0
        while start < len(ends):
            base = ends[start - 1] if start else 0
            stop = max(int(np.searchsorted(ends, base + limit, side="right")), start + 1)
            yield batch.slice(start, stop - start)
            start = stop


def worker_cache(name: str, make):
    """An object that lives as long as the Python worker, so tasks of one worker share it."""
    module = sys.modules.setdefault("_leafledger_worker", types.ModuleType("_leafledger_worker"))
    if not hasattr(module, name):
        setattr(module, name, make())
    return getattr(module, name)


def bounded_sample(rows: DataFrame, key: str, bound: int) -> DataFrame:
    """``bound`` distinct keys in an order fixed by their hash; the only rows a fit sees.

    A hash threshold at twice the bound comes first, so that tasks hand few keys to the final order.
    """
    keys = rows.select(key).filter(F.col(key).isNotNull()).distinct()
    total = keys.count()
    place = F.pmod(F.xxhash64(key), F.lit(max(total, 1)))
    return keys.filter(place < 2 * bound).orderBy(place, key).limit(bound)
