"""Gram counts against a count by hand, and what the postings and the search shuffle."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from leafledger.functions.grams import gram_counts
from leafledger.operators import search as S

NOTE = "vault_id string, path string, rev long, content string, deleted boolean, kind string, size long"
ALPHABET = "ab é中한😀\n"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def counted(text):
    return Counter(text[i:i + 3] for i in range(len(text) - 2))


def some_notes(spark, count=60):
    rng = random.Random(5)
    texts = ["", "ab", None, "aaaa", *["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(90))) for _ in range(count)]]
    # Every fifth path comes twice, one of them three times with the same text.
    rows = [("v", f"p{i - i % 5 // 4}.md", 1, t, False, "text", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[10], rows[10]], NOTE)


@pytest.mark.parametrize("most", [3, 400])
def test_grams_of_a_list_of_texts(spark, most):
    rng = random.Random(most)
    rows = [[None if rng.random() < 0.1 else "".join(rng.choice(ALPHABET) for _ in range(rng.randrange(most))) for _ in range(rng.randrange(4))] for _ in range(40)]
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "id int, texts array<string>").coalesce(1)
    for row in frame.select("id", gram_counts(F.col("texts")).alias("g")).collect():
        want = sum((counted(t) for t in rows[row.id] if t is not None), Counter())
        assert {g.gram: g.tf for g in row.g} == want and len(row.g) == len(want)


def test_postings_of_repeated_paths_and_odd_texts(spark):
    notes = S.indexed_notes(some_notes(spark))
    want = Counter()
    for n in notes.collect():
        want.update({(n.vault_id, gram, n.path): tf for gram, tf in counted(n.folded or "").items()})
    have = S.build_postings(notes).collect()
    assert {(r.vault_id, r.gram, r.path): r.tf for r in have} == want and len(have) == len(want)


def test_postings_are_not_shuffled(spark):
    """Texts travel once; the postings, many times as many rows, are made behind the last shuffle."""
    plan = plan_of(S.build_postings(S.indexed_notes(some_notes(spark)))).split("Generate inline")
    assert len(plan) == 2 and "Exchange" not in plan[0] and "Aggregate" not in plan[0]


def test_search_builds_its_index_once(spark):
    rows = [("v", 1, "needle"), ("v", 2, "other")]
    notes = spark.createDataFrame([("v", f"{i}.md", 1, f"one needle {i}", False, "text", 9) for i in range(4)], NOTE)
    found = S.search_notes(spark.createDataFrame(rows, "vault_id string, query_id int, query string"), notes, "e")
    assert "Generate" not in plan_of(found)
    assert [(r.path, r["rank"]) for r in found.orderBy("rank").collect()] == [(f"{i}.md", i + 1) for i in range(4)]
