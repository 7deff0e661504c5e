"""Language ID by a byte convolutional network: filters of several widths, max pooling, softmax.

Texts are cut into windows of ``WINDOW`` bytes (the last one padded with zero bytes). A filter's weight for
(place, byte) is a table entry, so a filter's response is a sum of table rows; the maximum over a window
goes to one dense layer. A document's prediction is the mean log probability over all its windows. The fit
runs in one task over at most ``FIT_DOCS`` labelled documents, of each at most ``FIT_WINDOWS`` windows; rows held out
or without ``lang`` are never learned from, and only ``text`` is an input of a prediction.

NULL text and text without a letter give ``und`` with score 0, and so does every text if nothing could be
learned. NULL ids are not held out and not learned from. Repeated rows are predicted one by one; other
columns of the input are ignored.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, byte_texts, fold_of, fold_of_id, slices

FOLDS = 5
WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
FIT_DOCS = 2_000
FIT_WINDOWS = 196  # of one document
_WORD = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    """True if a character is a letter; fractions, circled and Roman number signs are word characters but no letters."""
    return any(m[0].isalpha() for m in _WORD.finditer(text))


def windows_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All windows of the texts as rows of bytes, and the number of windows of each text."""
    counts = np.array([-(-len(t) // WINDOW) for t in texts], np.int64)
    padded = b"".join(t + bytes(-len(t) % WINDOW) for t in texts)
    return np.frombuffer(padded, np.uint8).reshape(-1, WINDOW), counts


def spread_windows(text: bytes, most: int = FIT_WINDOWS) -> bytes:
    """At most ``most`` windows of a text, spread evenly from its beginning to its end; a shorter text as it is."""
    count = -(-len(text) // WINDOW)
    if count <= most:
        return text
    starts = np.linspace(0, count - 1, most).round().astype(int) * WINDOW
    return b"".join(text[a : a + WINDOW] for a in starts.tolist())


def _responses(windows: np.ndarray, tables: list[np.ndarray], where: bool = False):
    """Largest response per window and filter, and its place if ``where``."""
    best, places = [], []
    for width, table in zip(WIDTHS, tables):
        span = WINDOW - width + 1
        total = table[0][windows[:, :span]]
        for k in range(1, width):
            total += table[k][windows[:, k : k + span]]
        best.append(total.max(axis=1))
        if where:
            places.append(total.argmax(axis=1))
    return np.concatenate(best, axis=1), places


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit_network(texts: list[bytes], labels: list[str], epochs: int = 3, batch: int = 128, rate: float = 0.01) -> dict:
    """Filters, dense layer and language names, by Adam on windows weighed so that languages count alike."""
    names = sorted(set(labels))
    windows, counts = windows_of(texts)
    goal = np.repeat([names.index(x) for x in labels], counts)
    weight = len(goal) / (len(names) * np.maximum(np.bincount(goal, minlength=len(names)), 1))
    rng = np.random.default_rng(7)
    params = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
    params += [rng.normal(0, 0.3, (len(WIDTHS) * FILTERS, len(names))).astype(np.float32), np.zeros(len(names), np.float32)]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), batch):
            rows, y = windows[order[at : at + batch]], goal[order[at : at + batch]]
            raw, places = _responses(rows, params[:-2], True)
            hidden = np.tanh(raw)
            error = _softmax(hidden @ params[-2] + params[-1])
            error[np.arange(len(y)), y] -= 1
            error *= weight[y][:, None] / len(y)
            back = (error @ params[-2].T) * (1 - hidden * hidden)
            grads = []
            for n, (width, place) in enumerate(zip(WIDTHS, places)):
                own = back[:, n * FILTERS : (n + 1) * FILTERS]
                grad = np.zeros_like(params[n])
                for k in range(width):
                    np.add.at(grad[k], (rows[np.arange(len(rows))[:, None], place + k], np.arange(FILTERS)[None, :]), own)
                grads.append(grad)
            grads += [hidden.T @ error, error.sum(axis=0)]
            step += 1
            for p, g, m, v in zip(params, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
    return {"names": names, "tables": params[:-2], "dense": params[-2], "bias": params[-1]}


def predict(texts: list[bytes], model: dict, chunk: int = 1024) -> list[tuple[str, float]]:
    """Language and its probability per non-empty text, over all its windows."""
    windows, counts = windows_of(texts)
    logs = np.empty((len(windows), len(model["names"])))
    for at in range(0, len(windows), chunk):
        raw, _ = _responses(windows[at : at + chunk], model["tables"])
        logs[at : at + chunk] = np.log(_softmax(np.tanh(raw) @ model["dense"] + model["bias"]) + 1e-12)
    ends = np.cumsum(counts)
    sums = np.concatenate([np.zeros((1, logs.shape[1])), np.cumsum(logs, axis=0)])
    chance = _softmax((sums[ends] - sums[ends - counts]) / np.maximum(counts, 1)[:, None])
    return [(model["names"][k], float(min(row[k], 1.0))) for k, row in zip(chance.argmax(axis=1).tolist(), chance)]


def _pack(model: dict) -> dict:
    arrays = [*model["tables"], model["dense"], model["bias"]]
    return {"names": json.dumps(model["names"]), "weights": b"".join(a.astype("<f4").tobytes() for a in arrays)}


def _unpack(row: dict) -> dict:
    names, flat, at = json.loads(row["names"]), np.frombuffer(row["weights"], "<f4"), 0
    shapes = [(w, 256, FILTERS) for w in WIDTHS] + [(len(WIDTHS) * FILTERS, len(names)), (len(names),)]
    arrays = []
    for shape in shapes:
        size = int(np.prod(shape))
        arrays.append(flat[at : at + size].reshape(shape))
        at += size
    return {"names": names, "tables": arrays[:-2], "dense": arrays[-2], "bias": arrays[-1]}


def fit_languages(docs: DataFrame, fit_docs: int = FIT_DOCS, folds: int = FOLDS, fit_windows: int = FIT_WINDOWS) -> dict | None:
    """The network's weights (tens of kilobytes); None if no row can be learned from.

    ``fit_docs`` documents of any length are seen, of each at most ``fit_windows`` windows spread over the whole text. Of several rows
    with one id the smallest language and text count.
    """
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text").filter(F.col("lang").isNotNull() & (fold_of(F.col("doc_id"), folds) != 0))
    known = known.filter(F.octet_length("text") > 0)
    chosen = bounded_sample(known, "doc_id", fit_docs)

    def cut(batches):
        for batch in slices(batches, "text"):
            kept = [spread_windows(t, fit_windows) for t in byte_texts(batch.column("text"))]
            yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(kept, pa.binary()))

    # Windows are cut where the texts are, so only they are moved.
    windows = known.join(F.broadcast(chosen), "doc_id").select("doc_id", "lang", "text").mapInArrow(cut, "doc_id long, lang string, text binary")
    rows = windows.groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("r")).select("doc_id", "r.lang", "r.text")

    def train(batches):
        found = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: r["doc_id"])
        if found:
            packed = _pack(fit_network([bytes(r["text"]) for r in found], [r["lang"] for r in found]))
            yield pa.RecordBatch.from_pylist([packed], pa.schema([("names", pa.string()), ("weights", pa.binary())]))

    row = rows.repartition(1).mapInArrow(train, "names string, weights binary").first()
    return row and row.asDict()


def predict_languages(docs: DataFrame, packed: dict | None, folds: int = FOLDS) -> DataFrame:
    """One row per document: whether it was held out, its language and the probability."""

    def label(batches):
        model = packed and _unpack(packed)
        for batch in slices(batches, "text", 1 << 20):
            ids, texts = batch.column("doc_id").to_pylist(), byte_texts(batch.column("text"))
            spoken = [k for k, t in enumerate(texts) if model and t and has_letter(t.decode("utf-8", "replace"))]
            out = [("und", 0.0)] * len(texts)
            for k, found in zip(spoken, predict([texts[k] for k in spoken], model) if spoken else []):
                out[k] = found
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([fold_of_id(i, folds) == 0 for i in ids]), pa.array([o[0] for o in out]), pa.array([o[1] for o in out])],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        label, "doc_id long, held_out boolean, lang_pred string, score double"
    )


def identify_languages(docs: DataFrame) -> DataFrame:
    """Fit on the learnable rows and predict every document."""
    return predict_languages(docs, fit_languages(docs))
