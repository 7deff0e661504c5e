"""Packing into sequences of several lengths: tiers, gap filling and balanced step groups.

A document's whole windows of the longest tier are sequences of their own. Its rest goes to the
shortest tier that holds it. Tiers are packed from the longest down: a rest opens a window, the gap
takes the largest rest of a shorter tier that fits, and when none fits a rest is cut. So windows are
full; what is left at the end of a pool is cut into powers of two, which need no padding. A pool is a
run of whole documents of one task with at least ``POOL`` tokens together, so memory holds one pool
(and one document). Sequences of a pool are dealt to step groups of about ``STEP_TOKENS`` tokens, the
longest first, each to the group with the fewest tokens.

NULL text is an empty document with its end id alone. NULL ids and repeated rows are documents of their
own; other columns of the input are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, slices
from .tokens import CACHE, encoder

END = 0
TIERS = [128, 256, 512, 1024]
POOL = 1 << 21
STEP_TOKENS = 64 * 1024

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "sequence_length long, step_group long"
)


def pack_lengths(lengths: list[int], tiers: list[int] = TIERS) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of pieces (document, start, length) that cover every token once."""
    longest = tiers[-1]
    sequences: list[list[tuple[int, int, int]]] = []
    rests: list[list[tuple[int, int, int]]] = [[] for _ in tiers]  # per tier (length, document, start), sorted

    def route(length: int, doc: int, start: int) -> None:
        insort(rests[next(k for k, tier in enumerate(tiers) if tier >= length)], (length, doc, start))

    for doc, length in enumerate(lengths):
        whole = length // longest
        sequences += [[(doc, longest * k, longest)] for k in range(whole)]
        if length % longest:
            route(length % longest, doc, longest * whole)

    def fitting(gap: int, below: int) -> tuple[int, int, int] | None:
        """The largest rest of the tiers up to ``below`` that fits."""
        for tier in range(below, -1, -1):
            at = bisect_right(rests[tier], (gap, len(lengths), 0))
            if at:
                return rests[tier].pop(at - 1)
        return None

    for level in range(len(tiers) - 1, -1, -1):
        while rests[level]:
            length, doc, start = rests[level].pop()
            window, gap = [(doc, start, length)], tiers[level] - length
            while gap:
                found = fitting(gap, level)
                if found is None:
                    source = next((r for r in reversed(rests[: level + 1]) if r), None)
                    if source is None:
                        break
                    length, doc, start = source.pop()  # longer than the gap: cut it
                    route(length - gap, doc, start + gap)
                    found = (gap, doc, start)
                window.append((found[1], found[2], found[0]))
                gap -= found[0]
            sequences += [window] if not gap else _powers(window)
    return sequences


def _powers(window: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """A window that could not be filled, cut into sequences of powers of two."""
    total, out, todo = sum(p[2] for p in window), [], list(reversed(window))
    for bit in range(total.bit_length() - 1, -1, -1):
        room, sequence = total & (1 << bit), []
        while room:
            doc, start, length = todo.pop()
            taken = min(room, length)
            sequence.append((doc, start, taken))
            if taken < length:
                todo.append((doc, start + taken, length - taken))
            room -= taken
        if sequence:
            out.append(sequence)
    return out


def step_groups(sizes: list[int], step_tokens: int = STEP_TOKENS) -> list[int]:
    """A group per sequence, so that groups hold about equal numbers of tokens."""
    loads = [(0, group) for group in range(max(1, round(sum(sizes) / step_tokens)))]
    out = [0] * len(sizes)
    for at in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        load, group = heapq.heappop(loads)
        out[at] = group
        heapq.heappush(loads, (load + sizes[at], group))
    return out


def _pack(path: str, pool_tokens: int, cache: int):
    def rows_of(pool: int, doc_ids: list, parts: list[bytes]) -> pa.RecordBatch:
        sequences = pack_lengths([len(p) // 4 for p in parts])
        sizes = [sum(p[2] for p in s) for s in sequences]
        groups = step_groups(sizes)
        base = (TaskContext.get().partitionId() << 43) | (pool << 22)
        rows = []
        for number, (sequence, size, group) in enumerate(zip(sequences, sizes, groups)):
            offset = 0
            for doc, start, length in sequence:
                check = zlib.crc32(memoryview(parts[doc])[4 * start : 4 * (start + length)])
                rows.append((doc_ids[doc], start, length, check, len(parts[doc]) // 4, base + number, offset, size, base + group))
                offset += length
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length", "step_group"]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)

    def pack(batches: Iterator[pa.RecordBatch]):
        tokens, end = encoder(path, "byte", cache), np.array([END], "<u4").tobytes()
        pool, size = 0, 0
        doc_ids: list = []
        parts: list[bytes] = []
        for batch in slices(batches, "text"):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), byte_texts(batch.column("text"))):
                doc_ids.append(doc_id)
                parts.append(tokens.encode(text or b"") + end)
                size += len(parts[-1]) // 4
                if size >= pool_tokens:
                    yield rows_of(pool, doc_ids, parts)
                    pool, size, doc_ids, parts = pool + 1, 0, [], []
        if parts:
            yield rows_of(pool, doc_ids, parts)

    return pack


def pack_documents(docs: DataFrame, vocabulary: str, pool_tokens: int = POOL, cache: int = CACHE) -> DataFrame:
    """One row per piece, in place within its sequence. No shuffle: every task packs the documents it reads.

    ``cache`` bounds the word pieces that a Python worker keeps; it trades memory for time alone.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_pack(vocabulary, pool_tokens, cache), SCHEMA)
