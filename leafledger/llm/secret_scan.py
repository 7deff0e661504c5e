"""Secret scans: one byte pass of a combined automaton over every whole text.

Kinds ``assign``, ``access`` and ``hex`` are the base; the others are added by this operator. Positions
are code points, ends exclusive. NULL and empty texts have no spans. NULL ids and repeated rows are
scanned like any other row; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automaton import Rule, Scanner
from .common import byte_texts, slices

BASE = 3
RULES = [
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", r"[A-Za-z0-9+/_.=\-]", 12, fold=True),
    Rule("access", r"AKIA", r"[A-Z0-9]", 14),
    Rule("hex", r"", r"[0-9a-f]", 16),
    Rule("github", r"gh[pousr]_", r"[A-Za-z0-9]", 36),
    Rule("slack", r"xox[abprs]-", r"[A-Za-z0-9\-]", 20),
    Rule("google", r"AIza", r"[A-Za-z0-9_\-]", 35),
    Rule("jwt", r"eyJ", r"[A-Za-z0-9_.\-]", 40),
    Rule("pem", r"-----BEGIN\x20([A-Z]+\x20)?PRIVATE\x20KEY-----", r"[A-Za-z0-9+/=\r\n\x20]", 20),
]


def _points(text: bytes, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Byte positions to code points, by one count of the bytes that begin a character."""
    if not found or text.isascii():
        return found
    begins = np.flatnonzero(np.frombuffer(text, np.uint8) & 0xC0 != 0x80)
    starts, ends = (np.searchsorted(begins, [f[k] for f in found]).tolist() for k in (0, 2))
    return [(start, bit, end) for start, (_, bit, _), end in zip(starts, found, ends)]


def _listed(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{RULES[bit].kind}:{start}:{end}" for start, bit, end in found)


def mask(text: bytes, found: list[tuple[int, int, int]]) -> bytes:
    """The text with every stretch of overlapping spans replaced by its first kind in brackets."""
    out, done = [], 0
    for start, bit, end in sorted(found, key=lambda f: (f[0], f[1])):
        if start >= done:
            out += [text[done:start], f"[{RULES[bit].kind}]".encode()]
        done = max(done, end)
    return b"".join(out + [text[done:]])


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Counts per base kind, digest of the base spans and all spans, one row per document."""
    scanner = Scanner(RULES)

    def scan(batches):
        for batch in slices(batches, "text"):
            texts = [t or b"" for t in byte_texts(batch.column("text"))]
            rows = [_points(t, f) for t, f in zip(texts, scanner.scan(texts))]
            base = [[f for f in row if f[1] < BASE] for row in rows]
            counts = [pa.array([sum(f[1] == bit for f in row) for row in base], pa.int64()) for bit in range(BASE)]
            digests = [hashlib.sha256(_listed(row).encode()).hexdigest() for row in base]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *counts, pa.array(digests, pa.string()), pa.array([_listed(row) for row in rows], pa.string())],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    )


def mask_secrets(docs: DataFrame) -> DataFrame:
    """The documents with every span masked in ``text``; other columns as they are."""
    scanner = Scanner(RULES)
    at = docs.columns.index("text")

    def hide(batches):
        for batch in slices(batches, "text"):
            texts = byte_texts(batch.column(at))
            found = scanner.scan([t or b"" for t in texts])
            clean = pa.array([t if not f else mask(t, f) for t, f in zip(texts, found)], pa.binary()).cast(pa.string())
            yield batch.set_column(at, "text", clean)

    return docs.mapInArrow(hide, docs.schema)
