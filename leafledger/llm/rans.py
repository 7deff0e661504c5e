"""Token ids as files of range asymmetric numeral system blocks, and back.

Documents are dealt to shards by ranges of ``doc_id`` and sorted. A task encodes its shard group by
group: a group is whole documents of at least ``GROUP`` tokens together, and all its blocks share one
static frequency table. A block holds ``LANES * STEPS`` tokens, dealt to interleaved lanes that
share one stream of 32-bit words; at every ``STEPS / CHECKPOINTS`` steps the states and the stream
position are kept, so that a block decodes from each checkpoint on its own, and a checksum covers
its ids. A file row holds one group; rows are written as Parquet in ascending order.

NULL text is an empty document with its end id alone; NULL ids sort first; equal ids follow each other
in the order of their texts; other columns of the input are ignored. Without rows there are no
groups. A wrong checksum stops the read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import byte_texts, shared_folder, slices
from .tokens import encoder

END = 1
BITS = 18
LOW = np.uint64(1 << 31)
LANES, STEPS, CHECKPOINTS = 32, 1024, 4
BLOCK = LANES * STEPS
GROUP = 1 << 20

FILE_SCHEMA = (
    "shard int, seq int, shard_start long, n_tokens long, doc_ids array<long>, doc_tokens array<long>, symbols binary, "
    "freqs binary, states binary, offsets binary, checks binary, payload binary"
)


def frequencies(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of a group and their frequencies, scaled to sum to ``2**BITS`` with none below 1."""
    counts = np.bincount(ids)
    symbols = np.flatnonzero(counts)
    counts, total = counts[symbols], 1 << BITS
    freqs = np.maximum(counts * (total - len(symbols)) // counts.sum(), 0) + 1
    freqs[np.argmax(freqs)] += total - freqs.sum()
    return symbols.astype(np.uint32), freqs.astype(np.uint32)


def encode_group(ids: np.ndarray) -> dict[str, bytes]:
    """All blocks of a group side by side, from the last step to the first."""
    symbols, freqs = frequencies(ids)
    blocks = -(-len(ids) // BLOCK)
    # Places behind the last id take a symbol that owns the whole range: coding it changes nothing.
    f = np.concatenate([freqs, [1 << BITS]]).astype(np.uint64)
    c = np.concatenate([np.cumsum(freqs) - freqs, [0]]).astype(np.uint64)
    grid = np.full(blocks * BLOCK, len(symbols), np.int64)
    rank = np.zeros(int(symbols[-1]) + 1, np.int64)
    rank[symbols] = np.arange(len(symbols))
    grid[: len(ids)] = rank[ids]
    grid = np.ascontiguousarray(grid.reshape(blocks, STEPS, LANES).transpose(1, 0, 2))
    state = np.full((blocks, LANES), LOW, np.uint64)
    words, moved = np.zeros(grid.shape, np.uint32), np.zeros(grid.shape, bool)
    kept = np.zeros((blocks, CHECKPOINTS, LANES), np.uint64)
    each = STEPS // CHECKPOINTS
    for step in range(STEPS - 1, -1, -1):
        own = f[grid[step]]
        over = state >= own << np.uint64(63 - BITS)
        words[step] = state & np.uint64(0xFFFFFFFF)
        moved[step] = over
        state = np.where(over, state >> np.uint64(32), state)
        whole = state // own
        state = (whole << np.uint64(BITS)) + (state - whole * own) + c[grid[step]]
        if step % each == 0:
            kept[:, step // each] = state
    moved = moved.transpose(1, 0, 2)
    per_part = moved.reshape(blocks * CHECKPOINTS, -1).sum(axis=1)
    raw = ids.astype("<u4").tobytes()
    return {
        "symbols": symbols.astype("<u4").tobytes(),
        "freqs": freqs.astype("<u4").tobytes(),
        "states": kept.astype("<u8").tobytes(),
        "offsets": (np.cumsum(per_part) - per_part).astype("<u8").tobytes(),
        "checks": np.array([zlib.crc32(raw[4 * BLOCK * b : 4 * BLOCK * (b + 1)]) for b in range(blocks)], "<u4").tobytes(),
        "payload": words.transpose(1, 0, 2)[moved].astype("<u4").tobytes(),
    }


def decode_group(row: dict, n_tokens: int) -> np.ndarray:
    """All checkpoints of all blocks side by side; raises on a wrong checksum."""
    symbols, freqs = np.frombuffer(row["symbols"], "<u4"), np.frombuffer(row["freqs"], "<u4")
    blocks, each = -(-n_tokens // BLOCK), STEPS // CHECKPOINTS
    f, c = freqs.astype(np.uint64), (np.cumsum(freqs) - freqs).astype(np.uint64)
    owner = np.repeat(np.arange(len(symbols), dtype=np.int32), freqs)
    state = np.frombuffer(row["states"], "<u8").reshape(blocks * CHECKPOINTS, LANES).copy()
    at = np.frombuffer(row["offsets"], "<u8").astype(np.int64)
    words = np.concatenate([np.frombuffer(row["payload"], "<u4").astype(np.uint64), np.zeros(1, np.uint64)])
    first = (np.arange(blocks * CHECKPOINTS) * each * LANES)[:, None] + np.arange(LANES)[None, :]
    out = np.zeros((blocks * CHECKPOINTS, each, LANES), np.int32)
    slot_mask = np.uint64((1 << BITS) - 1)
    for step in range(each):
        slot = state & slot_mask
        symbol = owner[slot.astype(np.int64)]
        out[:, step] = symbol
        moved = f[symbol] * (state >> np.uint64(BITS)) + slot - c[symbol]
        live = first + step * LANES < n_tokens
        need = live & (moved < LOW)
        place = at[:, None] + np.cumsum(need, axis=1) - 1
        refill = (moved << np.uint64(32)) | words[np.where(need, place, len(words) - 1)]
        state = np.where(live, np.where(need, refill, moved), state)
        at = at + need.sum(axis=1)
    ids = symbols[out.reshape(-1)[:n_tokens]]
    raw, checks = ids.astype("<u4").tobytes(), np.frombuffer(row["checks"], "<u4")
    for block in range(blocks):
        if zlib.crc32(raw[4 * BLOCK * block : 4 * BLOCK * (block + 1)]) != checks[block]:
            raise ValueError(f"checksum of block {block} differs")
    return ids


def _encode(path: str, group: int):
    def encode(batches: Iterator[pa.RecordBatch]):
        tokens, shard = encoder(path, "word"), TaskContext.get().partitionId()
        end, seq, start = np.array([END], "<u4").tobytes(), 0, 0
        doc_ids: list = []
        parts: list[bytes] = []
        size = 0

        def flush():
            ids = np.frombuffer(b"".join(parts), "<u4")
            row = {"shard": shard, "seq": seq, "shard_start": start, "n_tokens": len(ids), "doc_ids": doc_ids, "doc_tokens": [len(p) // 4 for p in parts]}
            row |= encode_group(ids)
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())] + [pa.binary()] * 6
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), kinds)], list(row))

        for batch in slices(batches, "text"):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), byte_texts(batch.column("text"))):
                doc_ids.append(doc_id)
                parts.append(tokens.encode(text or b"") + end)
                size += len(parts[-1]) // 4
                if size >= group:
                    yield flush()
                    seq, start, size, doc_ids, parts = seq + 1, start + size, 0, [], []
        if parts:
            yield flush()

    return encode


def write_ids(docs: DataFrame, vocabulary: str, folder: str, group: int = GROUP) -> None:
    """Encode every whole text and write the files to ``folder``."""
    shards = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(_encode(vocabulary, group), FILE_SCHEMA).write.parquet(folder)


def read_ids(spark, folder: str) -> DataFrame:
    """Per document from the files: first token within all documents, number of tokens and crc32 of the ids."""
    files = spark.read.schema(FILE_SCHEMA).parquet(folder)

    def decode(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                raw = decode_group(row, row["n_tokens"]).astype("<u4").tobytes()
                counts = np.array(row["doc_tokens"], np.int64)
                ends = np.cumsum(counts)
                checks = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for n, e in zip(counts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["shard"]] * len(counts), pa.int32()), pa.array(row["doc_ids"], pa.int64()),
                     pa.array(ends - counts + row["shard_start"]), pa.array(counts), pa.array(checks, pa.int64())],
                    ["shard", "doc_id", "start", "n_tokens", "ids_crc32"],
                )

    found = files.mapInArrow(decode, "shard int, doc_id long, start long, n_tokens long, ids_crc32 long")
    sizes = files.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    offsets = sizes.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return found.join(offsets, "shard").select("doc_id", (F.col("start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def ids_round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Write the files to the shared folder and read the documents back from them."""
    folder = shared_folder(docs.sparkSession, "token-ids")
    write_ids(docs, vocabulary, folder)
    return read_ids(docs.sparkSession, folder)
