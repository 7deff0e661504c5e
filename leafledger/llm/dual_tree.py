"""Ranked lexical search: the best documents of every item by a dual-tree search, exact.

A document's impact for a term is an integer that depends on the term's weight, its frequency and the document's length;
an item's score for a document is the sum of the impacts of the item's terms. One pass over the texts writes each
document's counts of the items' terms; document frequencies and totals come from that table. Then each task takes its
documents in batches, builds a hierarchy over a batch whose nodes hold the coordinate maxima of the impacts, and walks it
against a hierarchy over the items whose nodes hold the maxima of the items' term indicators. The product of two nodes'
maxima bounds every score of the pair; a pair below the weakest kth score of its items is left with all it holds. A pair
that equals it is followed, so ties are decided by doc_id. Kth scores start from a search of a thirty-second of the documents: only a
lower bound, results do not depend on it. The tasks' best rows are ranked together per item.

Items come in blocks of about ``ITEM_BYTES`` bytes of text; only a block's terms travel to the tasks.

NULL or empty texts have no terms and are never found, and do not count as documents. Rows with a NULL doc_id rank after
others of the same score. Repeated rows are found as often as they occur; rows with the same item_id make one
item with the terms of all. Items without a known term have no rows. Other columns are ignored, empty tables give no rows.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import byte_texts, slices, stored

TOP = 10
ITEM_BYTES = 4 << 20
ITEM_LEAF, DOC_LEAF = 8, 16
CELLS = 2 << 20  # of a batch's dense impacts
PIECE = 1 << 20  # bytes of a long text that are cut into terms at once
PILOT = 32
# Digits, letters and all of UTF-8 beyond ASCII.
_TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_GAP = re.compile(rb"[^0-9A-Za-z\x80-\xff]")

VECTORS = "doc_id long, n long, terms array<int>, counts array<int>"
FOUND = "item int, doc_id long, score long"


def _term_lists(raw: bytes):
    """Lowered terms of a text in lists of about ``PIECE`` bytes; a term is never cut."""
    start = 0
    while len(raw) - start > PIECE:
        gap = _GAP.search(raw, start + PIECE)
        if gap is None:
            break
        yield _TERM.findall(raw[start : gap.start()].lower())
        start = gap.start()
    yield _TERM.findall(raw[start:].lower())


def terms_of(text: str | None) -> set[bytes]:
    return {t for some in _term_lists((text or "").encode()) for t in some}


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    ends = np.r_[0, np.cumsum(sizes)].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values.astype(np.int32), pa.int32()))


def _vectors(shared):
    """Length and counts of known terms of each text that has a term."""

    def cut(batches):
        known = shared.value
        for batch in batches:
            for part in slices([batch], "text"):
                sizes, owners, ids = [], [], []
                for at, raw in enumerate(byte_texts(part.column("text"))):
                    n, met = 0, []
                    for some in _term_lists(raw or b""):
                        n += len(some)
                        met += [i for i in map(known.get, some) if i is not None]
                    sizes.append(n)
                    owners.append(len(met))
                    ids.append(np.array(met, np.int64))
                keys = np.repeat(np.arange(len(sizes)), owners) * len(known) + np.concatenate(ids)
                keys, counts = np.unique(keys, return_counts=True)
                own = np.bincount(keys // max(len(known), 1), minlength=len(sizes))
                rows = pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(sizes, pa.int64()), _lists(keys % max(len(known), 1), own), _lists(counts, own)],
                    ["doc_id", "n", "terms", "counts"],
                )
                yield rows.filter(pa.array(np.array(sizes) > 0))

    return cut


def _tally(width: int):
    """A task's documents (term -1), terms (-2) and document frequencies."""

    def tally(batches):
        sums, rows, length = np.zeros(width, np.int64), 0, 0
        for batch in batches:
            rows += batch.num_rows
            length += sum(batch.column("n").to_pylist())
            sums += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=width)
        met = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.r_[-1, -2, met], pa.int32()), pa.array(np.r_[rows, length, sums[met]], pa.int64())], ["term", "n"]
        )

    return tally


# ---- the two hierarchies ---------------------------------------------------


@dataclass
class Items:
    """A node of the item hierarchy: its terms (the maxima of 0/1 indicators), and below them children or single items."""

    items: np.ndarray
    terms: np.ndarray
    children: list[Items]
    indicators: np.ndarray | None = None  # of a leaf: items x terms

    @staticmethod
    def of(sets: list[np.ndarray], items: np.ndarray | None = None) -> Items:
        items = np.arange(len(sets)) if items is None else items
        terms, counts = np.unique(np.concatenate([sets[i] for i in items]), return_counts=True) if len(items) else (np.array([], np.int64),) * 2
        # Items that hold the term met by nearest to half of them, and the rest.
        cut = terms[np.argmax(np.minimum(counts, len(items) - counts))] if len(terms) else None
        has = np.array([cut in sets[i] for i in items], bool)
        if len(items) <= ITEM_LEAF:
            held = np.zeros((len(items), len(terms)))
            for row, i in enumerate(items):
                held[row, np.searchsorted(terms, sets[i])] = 1
            return Items(items, terms, [], held)
        halves = [items[has], items[~has]] if has.any() and not has.all() else [items[: len(items) // 2], items[len(items) // 2 :]]
        return Items(items, terms, [Items.of(sets, half) for half in halves])


class Batch:
    """The hierarchy over a batch of documents: row order, node ranges and the coordinate maxima of each node."""

    def __init__(self, impacts: np.ndarray):
        self.impacts, self.maxima, self.children, self.rows = impacts, [], [], []
        self._grow(np.arange(len(impacts)))
        self.maxima = np.array(self.maxima)

    def _grow(self, rows: np.ndarray) -> int:
        own, node = self.impacts[rows], len(self.maxima)
        best = own.max(axis=0)
        self.maxima.append(best)
        self.children.append([])
        self.rows.append(rows)
        if len(rows) > DOC_LEAF:
            met = np.count_nonzero(own, axis=0)
            has = own[:, np.argmax(np.minimum(met, len(rows) - met) * best)] > 0
            halves = [rows[has], rows[~has]] if has.any() and not has.all() else [rows[: len(rows) // 2], rows[len(rows) // 2 :]]
            self.children[node] = [self._grow(half) for half in halves]
        return node


class Search:
    """Best rows of each item over batches; ``floors`` are scores that the kth best is known to reach."""

    def __init__(self, sets: list[np.ndarray], floors: np.ndarray, top: int):
        self.tree, self.top = Items.of(sets), top
        self.floors = np.maximum(floors, 1).astype(np.float64)
        self.best: list[list[tuple]] = [[] for _ in sets]
        self.pruned = self.scored = 0

    def add(self, impacts: np.ndarray, ids: list[int | None]) -> None:
        if len(ids) and len(self.best):
            self._walk(self.tree, Batch(impacts), ids)

    def _walk(self, node: Items, batch: Batch, ids: list) -> None:
        """Item nodes against the whole batch; below an item leaf the batch's nodes, a level at a time."""
        if batch.maxima[0, node.terms].sum() < self.floors[node.items].min():
            self.pruned += len(node.items) * len(ids)
            return
        for child in node.children:
            self._walk(child, batch, ids)
        if node.children:
            return
        level, reached = np.array([0]), []
        while len(level):
            bounds = batch.maxima[np.ix_(level, node.terms)] @ node.indicators.T
            open_nodes = level[(bounds >= self.floors[node.items]).any(axis=1)]
            below = []
            for at in open_nodes.tolist():
                if batch.children[at]:
                    below += batch.children[at]
                else:
                    reached.append(batch.rows[at])
            level = np.array(below, np.int64)
        rows = np.concatenate(reached) if reached else np.array([], np.int64)
        self.pruned += len(node.items) * (len(ids) - len(rows))
        if not len(rows):
            return
        # Sums of integers below 2 ** 53, exact as doubles.
        scores = batch.impacts[np.ix_(rows, node.terms)] @ node.indicators.T
        self.scored += scores.size
        for column, item in enumerate(node.items.tolist()):
            hits = np.flatnonzero(scores[:, column] >= self.floors[item])
            if not len(hits):
                continue
            new = [(-int(s), ids[r] is None, ids[r] or 0, ids[r]) for s, r in zip(scores[hits, column], rows[hits].tolist())]
            self.best[item] = sorted(self.best[item] + new, key=lambda b: b[:3])[: self.top]
            if len(self.best[item]) == self.top:
                self.floors[item] = max(self.floors[item], -self.best[item][-1][0])


def impacts_of(length: int, counts: np.ndarray, weights: np.ndarray, total_docs: int, total_terms: int) -> np.ndarray:
    """Integer impact of each term of one document."""
    m = 10 + 90 * length * total_docs // total_terms
    counts = counts.astype(np.int64)
    return weights * ((1_000_000_000 * counts) // (1_000 * counts + 8 * m))


def _search(shared, top: int):
    """The task's best rows of every item."""

    def search(batches):
        sets, weights, floors, total_docs, total_terms = shared.value
        found = Search(sets, floors, top)
        most = int(np.clip(CELLS // max(len(weights), 1), 1, 512))
        for batch in batches:
            for start in range(0, batch.num_rows, most):
                part = batch.slice(start, most)
                terms, counts = (part.column(c).to_pylist() for c in ("terms", "counts"))
                impacts = np.zeros((part.num_rows, len(weights)))
                for row, (n, own, met) in enumerate(zip(part.column("n").to_pylist(), terms, counts)):
                    if own:
                        impacts[row, own] = impacts_of(n, np.array(met), weights[own], total_docs, total_terms)
                found.add(impacts, part.column("doc_id").to_pylist())
        rows = [(item, b[3], -b[0]) for item, best in enumerate(found.best) for b in best]
        item, doc, score = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(item, pa.int32()), pa.array(doc, pa.int64()), pa.array(score, pa.int64())], ["item", "doc_id", "score"]
        )

    return search


def _ranked(found: DataFrame, top: int) -> DataFrame:
    best_first = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(best_first)).filter(F.col("rank") <= top)


def _search_block(docs: DataFrame, items: list[tuple[int | None, set[bytes]]], top: int) -> DataFrame:
    spark = docs.sparkSession
    known = {t: i for i, t in enumerate(sorted(set().union(*(terms for _, terms in items))))}
    vectors = stored(docs.mapInArrow(_vectors(spark.sparkContext.broadcast(known)), VECTORS), "search-vectors")
    tallied = vectors.select("n", "terms").mapInArrow(_tally(len(known)), "term int, n long")
    sums = {r.term: r.n for r in tallied.groupBy("term").agg(F.sum("n").alias("n")).collect()}  # one row a known term
    total_docs, total_terms = sums.get(-1, 0), sums.get(-2, 0)
    weights = np.array([math.floor(1000 * math.log((2 * total_docs + 2) / (2 * sums.get(i, 0) + 1))) for i in range(len(known))], np.int64)
    sets = [np.array(sorted(known[t] for t in terms), np.int64) for _, terms in items]

    def search(rows: DataFrame, floors: np.ndarray) -> DataFrame:
        shared = spark.sparkContext.broadcast((sets, weights, floors, total_docs, total_terms))
        return _ranked(rows.mapInArrow(_search(shared, top), FOUND), top)

    floors = np.ones(len(items))
    for row in search(vectors.filter(F.pmod(F.xxhash64("doc_id"), F.lit(PILOT)) == 0), floors).filter(F.col("rank") == top).collect():
        floors[row.item] = row.score
    names = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(items)], "item int, item_id long")
    return search(vectors, floors).join(names, "item").select("item_id", "rank", "doc_id", "score")


def search_documents(docs: DataFrame, items: DataFrame, top: int = TOP, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """One row per item and rank: the ``top`` documents of the highest score above 0."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    volume = asked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    blocks = max(-(-volume // item_bytes), 1)
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in range(blocks):
        sets: dict[int | None, set[bytes]] = {}
        for row in asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect():
            sets.setdefault(row.item_id, set()).update(terms_of(row.text))
        held = [(k, terms) for k, terms in sorted(sets.items(), key=lambda s: (s[0] is None, s[0] or 0)) if terms]
        if held:
            out = out.unionByName(_search_block(rows, held, top))
    return out


SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), counted AS (
  SELECT d, doc_id, len(terms) AS n, unnest(terms) AS term FROM docs
), vectors AS (
  SELECT d, doc_id, n, term, count(*) AS tf FROM counted GROUP BY ALL
), totals AS (
  SELECT count(*) AS docs, sum(len(terms))::BIGINT AS terms FROM docs WHERE len(terms) > 0
), frequencies AS (
  SELECT term, count(*) AS df FROM vectors GROUP BY term
), asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), scored AS (
  SELECT a.item_id, v.d, v.doc_id, sum(
    floor(1000 * ln((2 * t.docs + 2)::DOUBLE / (2 * f.df + 1)))::BIGINT
    * ((1000000000 * v.tf) // (1000 * v.tf + 8 * (10 + (90 * v.n * t.docs) // t.terms))))::BIGINT AS score
  FROM asked a JOIN vectors v USING (term) JOIN frequencies f USING (term), totals t
  GROUP BY a.item_id, v.d, v.doc_id
)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST))::INTEGER AS rank, doc_id, score
FROM scored WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) <= 10
"""
