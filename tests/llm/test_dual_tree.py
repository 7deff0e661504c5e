import math
import random
import re
from collections import Counter

import numpy as np

from leafledger.llm import dual_tree

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def cut(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def slow(docs, items, top=10):
    vectors = [(doc_id, Counter(cut(text))) for doc_id, text in docs if cut(text)]
    total, length = len(vectors), sum(sum(v.values()) for _, v in vectors)
    df = Counter(t for _, v in vectors for t in v)
    weight = {t: math.floor(1000 * math.log((2 * total + 2) / (2 * n + 1))) for t, n in df.items()}
    asked = {}
    for item_id, text in items:
        asked.setdefault(item_id, set()).update(cut(text))
    out = set()
    for item_id, terms in asked.items():
        rows = []
        for doc_id, v in vectors:
            m = 100 - 90 + 90 * sum(v.values()) * total // length
            score = sum(weight[t] * (1_000_000_000 * v[t] // (1000 * v[t] + 8 * m)) for t in terms if t in v)
            if score > 0:
                rows.append((-score, doc_id is None, doc_id or 0, doc_id))
        out |= {(item_id, rank, r[3], -r[0]) for rank, r in enumerate(sorted(rows, key=lambda r: r[:3])[:top], 1)}
    return out


def found(spark, docs, items, **more):
    frame = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'x' AS rank", "1 AS score") if isinstance(items, list) else items
    rows = dual_tree.search_documents(docs, frame, **more).collect()
    got = {(r.item_id, r.rank, r.doc_id, r.score) for r in rows}
    assert len(got) == len(rows)
    return got


def test_awkward_rows_by_brute_force(spark, awkward):
    docs = [(r.doc_id, r.text) for r in awkward.collect()]
    items = [(1, "The THING, señor!"), (1, "être"), (2, None), (3, ""), (None, "tion ing"), (4, "one"), (4, "one"), (5, "nowhere zzz"), (6, "12 34")]
    assert found(spark, awkward, items) == slow(docs, items)


def test_documents_by_brute_force_in_one_block_and_in_many(spark, documents, texts):
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select("item_id", "text").collect()]
    want = slow(list(texts.items()), items)
    assert found(spark, documents, items) == want
    assert found(spark, documents.repartition(9), items, item_bytes=2_000) == want


def test_ties_go_to_the_smaller_id_and_repeated_rows_stay(spark):
    docs = [(k, "alpha beta") for k in range(400, 0, -1)] + [(1, "alpha beta")] * 3 + [(k, "gamma") for k in range(500, 520)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    items = [(1, "alpha"), (2, "gamma beta")]
    rows = dual_tree.search_documents(frame, spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {i: [r.doc_id for r in sorted(rows, key=lambda r: r.rank) if r.item_id == i] for i in (1, 2)}
    assert got[1] == [1, 1, 1, 1, 2, 3, 4, 5, 6, 7] and got[2] == list(range(500, 510))


def test_empty_tables_and_a_very_long_text(spark, nothing):
    assert found(spark, nothing, [(1, "a")]) == set()
    docs = [(1, "Alpha beta-gamma " * 700_000 + "é" * 1_500_000), (2, "alpha"), (3, "delta " * 5)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert found(spark, frame, spark.createDataFrame([], "item_id long, text string")) == set()
    items = [(1, "alpha delta"), (2, "gamma " + "é" * 1_500_000)]
    assert found(spark, frame, items) == slow(docs, items)


def test_whole_batches_are_pruned_and_nothing_is_lost():
    rng = np.random.default_rng(1)
    random.seed(1)
    width, rows = 300, 1_500
    # Four topics of documents, and items of one topic each, some of them found in ten documents whole.
    impacts = np.zeros((rows, width))
    for row in range(rows):
        own = rng.choice(75, 30, replace=False) + 75 * (row % 4)
        impacts[row, own] = rng.integers(1, 1_000, 30)
    sets = [np.sort(rng.choice(75, 12, replace=False) + 75 * (i % 4)) for i in range(40)]
    for i, terms in enumerate(sets[:20]):
        impacts[np.ix_(rng.choice(rows, 12, replace=False), terms)] = 50_000 + i
    ids = rng.permutation(rows).tolist()
    search = dual_tree.Search(sets, np.ones(len(sets)), 10)
    for start in range(0, rows, 300):
        search.add(impacts[start : start + 300], ids[start : start + 300])
    for item, terms in enumerate(sets):
        scores = impacts[:, terms].sum(axis=1).astype(int)
        want = sorted((-s, d) for s, d in zip(scores.tolist(), ids) if s > 0)[:10]
        assert [(b[0], b[3]) for b in search.best[item]] == want
    assert search.pruned > 0.3 * rows * len(sets) and search.pruned + search.scored == rows * len(sets)
