"""Counts of three-character grams, a path's texts at a time.

Exploding every character into a row and adding up the rows costs microseconds a character; here each text is sorted as numbers
inside its Arrow batch, and only different grams become values.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Text bytes that are worked on at once.
SLICE_BYTES = 1 << 20
_COUNTS = pa.list_(pa.struct([("gram", pa.string()), ("tf", pa.int32())]))


def _counted(rows: list[list[bytes]]) -> pa.Array:
    """One list of (gram, tf) per row, in the order of code points; a row's texts count together, no gram spans two."""
    points, cuts, ends = [], [], []
    total = 0
    for texts in rows:
        for text in texts:
            points.append(np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), dtype="<u4"))
            cuts.append((total, total + max(len(points[-1]) - 2, 0)))
            total += len(points[-1])
        ends.append(len(cuts))
    if not total:
        return pa.array([[]] * len(rows), _COUNTS)
    code = np.concatenate(points).astype(np.int64)
    keys = np.zeros(total, dtype=np.int64)
    keys[: max(total - 2, 0)] = code[:-2] << 42 | code[1:-1] << 21 | code[2:]
    keys = np.concatenate([keys[a:b] for a, b in cuts])
    reached = np.concatenate([[0], np.cumsum([b - a for a, b in cuts])])[[0, *ends]]
    for a, b in zip(reached[:-1], reached[1:]):
        keys[a:b].sort()
    new = np.ones(len(keys), dtype=bool)
    new[1:] = keys[1:] != keys[:-1]
    new[reached[reached < len(keys)]] = True
    starts = np.flatnonzero(new)
    tf = np.diff(starts, append=len(keys)).astype(np.int32)
    found = keys[starts]
    three = np.stack([found >> 42, found >> 21 & 0x1FFFFF, found & 0x1FFFFF], axis=1).astype("<u4")
    width = (1 + (three >= 0x80) + (three >= 0x800) + (three >= 0x10000)).sum(axis=1)
    at = np.concatenate([[0], np.cumsum(width)]).astype(np.int32)
    data = three.tobytes().decode("utf-32-le").encode("utf-8")
    grams = pa.StringArray.from_buffers(len(found), pa.py_buffer(at), pa.py_buffer(data))
    lists = np.searchsorted(starts, reached).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(lists), pa.StructArray.from_arrays([grams, pa.array(tf)], ["gram", "tf"]))


@F.arrow_udf(T.ArrayType(T.StructType().add("gram", T.StringType()).add("tf", T.IntegerType())))
def _gram_counts(texts: pa.Array) -> pa.Array:
    out, rows, held = [], [], 0
    for place in range(len(texts)):
        row = [t.as_buffer().to_pybytes() for t in (texts[place].values or ()) if t.is_valid]
        rows.append(row)
        held += sum(map(len, row))
        if held >= SLICE_BYTES:
            out.append(_counted(rows))
            rows, held = [], 0
    if rows or not out:
        out.append(_counted(rows) if rows else pa.array([], _COUNTS))
    return pa.concat_arrays([part.cast(_COUNTS) for part in out])


def gram_counts(texts: Column) -> Column:
    """Different three-character windows of an array of texts with their number of occurrences, as ``array<struct<gram, tf>>``."""
    return _gram_counts(texts)
