"""Quality rules: base rules and a hashed n-gram logistic regression with calibrated probability.

Word 1- and 2-grams and character 3-, 4- and 5-grams are hashed to ``2**BITS`` buckets; a document's
logit is the mean weight of its word grams plus that of its character grams. The fit runs in one task over
at most ``fit_rows`` labelled documents of any length; of a text above ``fit_chars`` characters it sees
``FIT_WINDOWS`` passages spread over the whole text. A fifth of the documents calibrates the probability
(Platt). Of several rows with one id the smallest label and text count. Every document is scored over its
whole text, in Arrow batches, against fixed thresholds.

NULL text has no words and fails the base rules. Without labels of both kinds the model accepts
everything, so the base rules alone decide. NULL ids and repeated rows are scored like any other row;
other columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, byte_texts, slices

BITS = 16
FIT_ROWS = 2_000
FIT_CHARS, FIT_WINDOWS = 200_000, 50
SLICE = 1 << 20  # text bytes scored at once; a character takes about 60 bytes of memory
SYMBOLS = [c.encode() for c in "#*$%&|<>"]
MIN_WORDS = 50
MAX_REPEAT_PCT = 50
MIN_PROBABILITY = 0.4
SCALE = 50.0

BASE_SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, quality double, kept boolean"
)


def base_counts(text: bytes) -> tuple[list[bytes], int, int, int, int]:
    """Words, code points in words, symbols, repeated lines, words in repeated 3-word windows."""
    words = text.split()
    lines = [line for line in text.split(b"\n") if line.strip()]
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        found, end = Counter(windows), 0
        for start, window in enumerate(windows):
            if found[window] > 1:
                repeated += start + 3 - max(end, start)
                end = start + 3
    return words, len(b"".join(words).decode("utf-8", "replace")), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated


def _bucket(codes: np.ndarray) -> np.ndarray:
    codes ^= codes >> np.uint32(15)
    codes *= np.uint32(0x9E3779B1)
    return codes >> np.uint32(32 - BITS)


def gram_buckets(texts: list[bytes], words: list[list[bytes]]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per family of grams: buckets, and each document's first and end position in them."""
    whole = [t.decode("utf-8", "replace") for t in texts]
    data = np.frombuffer("".join(whole).encode("utf-32-le"), "<u4")
    ends = np.cumsum([len(t) for t in whole], dtype=np.int64)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    out = []
    code = data * np.uint32(0x01000193)
    for n in (2, 3, 4, 5):
        code = (code[: len(data) - n + 1] ^ data[n - 1 :]) * np.uint32(0x01000193) if len(data) >= n else data[:0]
        if n > 2:
            out.append((_bucket(code + np.uint32(n)), np.minimum(starts, len(code)), np.clip(ends - n + 1, np.minimum(starts, len(code)), len(code))))
    counts = [len(w) for w in words]
    flat = np.fromiter((zlib.crc32(w) for doc in words for w in doc), np.uint32, sum(counts))
    ends = np.cumsum(counts, dtype=np.int64)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    pairs = flat[:-1] * np.uint32(0x85EBCA6B) + flat[1:] if len(flat) > 1 else flat[:0]
    out.append((_bucket(flat.copy()), starts, ends))
    out.append((_bucket(pairs), np.minimum(starts, len(pairs)), np.clip(ends - 1, np.minimum(starts, len(pairs)), len(pairs))))
    return out


def logits(texts: list[bytes], words: list[list[bytes]], weights: np.ndarray, bias: float) -> np.ndarray:
    """Bias plus, per family, the mean weight of the document's grams; ``weights`` has one row per family."""
    total = np.full(len(texts), bias)
    for row, (buckets, start, end) in zip(weights, gram_buckets(texts, words)):
        sums = np.concatenate([[0.0], np.cumsum(row[buckets], dtype=np.float64)])
        total += SCALE * (sums[end] - sums[start]) / np.maximum(end - start, 1)
    return total


def _fit(texts: list[bytes], labels: np.ndarray, rounds: int = 80, rate: float = 0.04, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Full-batch Adam on the log loss; both classes weigh the same."""
    size, cuts = 1 << BITS, np.cumsum([len(t) for t in texts]) // SLICE
    found: list[list[tuple]] = []
    for at in np.unique(cuts):  # runs of documents of about SLICE bytes
        low, high = np.searchsorted(cuts, [at, at + 1])
        run = texts[low:high]
        for family, (buckets, start, end) in enumerate(gram_buckets(run, [t.split() for t in run])):
            if family == len(found):
                found.append([])
            for doc, first, last in zip(range(low, high), start, end):
                keys, counts = np.unique(buckets[first:last], return_counts=True)
                found[family].append((keys.astype(np.int32), counts / max(last - first, 1) * SCALE, np.full(len(keys), doc, np.int32)))
    families = [tuple(map(np.concatenate, zip(*parts))) for parts in found]
    weights, bias = np.zeros((len(families), size)), 0.0
    first, second = np.zeros((len(families), size)), np.zeros((len(families), size))
    share = np.where(labels == 1, 0.5 / max(labels.sum(), 1), 0.5 / max((1 - labels).sum(), 1))
    for step in range(1, rounds + 1):
        score = np.full(len(texts), bias)
        for row, (keys, values, docs) in zip(weights, families):
            score += np.bincount(docs, values * row[keys], minlength=len(texts))
        error = (1 / (1 + np.exp(-score)) - labels) * share
        for k, (keys, values, docs) in enumerate(families):
            grad = np.bincount(keys, values * error[docs], minlength=size) + decay * weights[k]
            first[k] += 0.1 * (grad - first[k])
            second[k] += 0.01 * (grad * grad - second[k])
            weights[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)
        bias -= rate * error.sum()
    return weights, bias


def _calibrate(score: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Platt's a and b with his smoothed targets, by gradient steps on the standardized score."""
    pos, neg = labels.sum(), (1 - labels).sum()
    if not pos or not neg:
        return 1.0, 0.0
    target = np.where(labels == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    mid, spread = score.mean(), score.std() + 1e-9
    z, a, b = (score - mid) / spread, 1.0, 0.0
    for _ in range(2_000):
        gap = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30))) - target
        a, b = max(a - (gap * z).mean(), 0.01), b - gap.mean()
    return float(a / spread), float(b - a * mid / spread)


def _passages(fit_chars: int) -> Column:
    """A text, or of a longer one ``FIT_WINDOWS`` passages spread evenly over it, ``fit_chars`` characters together."""
    width = max(fit_chars // FIT_WINDOWS, 1)
    start = lambda k: (1 + F.floor(k * (F.length("text") - width) / (FIT_WINDOWS - 1))).cast("int")
    spread = F.transform(F.sequence(F.lit(0), F.lit(FIT_WINDOWS - 1)), lambda k: F.substring("text", start(k), F.lit(width)))
    return F.when(F.length("text") <= fit_chars, F.col("text")).otherwise(F.concat_ws("\n", spread))


def fit_quality(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, fit_chars: int = FIT_CHARS) -> dict | None:
    """Weights and calibration; None without labelled rows of both kinds. Only these small arrays reach the driver."""
    known = labels.select(F.col("doc_id").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter(F.col("quality").isin(0, 1))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = bounded_sample(known, "doc_id", fit_rows)
    rows = docs.select("doc_id", "text").filter("text IS NOT NULL").join(F.broadcast(chosen), "doc_id")
    rows = rows.select("doc_id", _passages(fit_chars).alias("text")).groupBy("doc_id").agg(F.min("text").alias("text"))
    rows = rows.join(known, "doc_id").select("doc_id", "text", "quality")

    def train(batches):
        found = [r for b in batches for r in b.to_pylist()]
        found.sort(key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"]))
        texts = [r["text"].encode() for r in found]
        marks = np.array([r["quality"] for r in found])
        held = np.arange(len(found)) % 5 == 0
        if len(set(marks[~held])) < 2:
            return
        weights, bias = _fit([t for t, h in zip(texts, held) if not h], marks[~held])
        test = [t for t, h in zip(texts, held) if h]
        a, b = _calibrate(logits(test, [t.split() for t in test], weights, bias), marks[held])
        yield pa.RecordBatch.from_pydict({"weights": [weights.astype(np.float32).tobytes()], "bias": [float(bias)], "a": [a], "b": [b]})

    row = rows.repartition(1).mapInArrow(train, "weights binary, bias double, a double, b double").first()
    return row and row.asDict()


def judge_quality(docs: DataFrame, model: dict | None, min_probability: float = MIN_PROBABILITY, keep: list[str] | None = None) -> DataFrame:
    """Counts, calibrated ``quality`` and ``kept`` per row; columns in ``keep`` come along with a leading underscore."""
    keep = keep or []
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        fitted = shared.value
        weights = fitted and np.frombuffer(fitted["weights"], np.float32).reshape(-1, 1 << BITS)
        for batch in slices(batches, "text", SLICE):
            texts = [t or b"" for t in byte_texts(batch.column("text"))]
            counts = [base_counts(t) for t in texts]
            words = [c[0] for c in counts]
            chance = np.ones(len(texts))
            if fitted:
                raw = fitted["a"] * logits(texts, words, weights, fitted["bias"]) + fitted["b"]
                chance = 1 / (1 + np.exp(-np.clip(raw, -30, 30)))
            n = np.array([len(w) for w in words], np.int64)
            repeated = np.array([c[4] for c in counts], np.int64)
            failed = (n < MIN_WORDS) | (100 * repeated > MAX_REPEAT_PCT * n)
            columns = [batch.column("doc_id").cast(pa.int64()), pa.array(n), *(pa.array([c[k] for c in counts], pa.int64()) for k in (1, 2, 3, 4)),
                       pa.array(failed), pa.array(chance), pa.array(~failed & (chance >= min_probability))]
            names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "quality", "kept"]
            yield pa.RecordBatch.from_arrays(columns + [batch.column(f"_{c}") for c in keep], names + [f"_{c}" for c in keep])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *[F.col(c).alias(f"_{c}") for c in keep])
    extra = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in source.schema[2:])
    return source.mapInArrow(score, BASE_SCHEMA + extra)


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the labelled rows and judge every document."""
    return judge_quality(docs, fit_quality(docs, labels))
