import re
from collections import defaultdict

import pytest

from leafledger.llm import mixing


def slow_targets(sizes, weights=(5, 2, 1), repeats=3):
    """Share out by weight; cut at the cap and share the excess again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(sizes.values()))
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = [s for s in open_ if share[s] >= repeats * sizes[s]]
        if not above:
            return target | share
        for s in above:
            target[s] = float(repeats * sizes[s])
            left -= target[s]
            open_.remove(s)
    return target


def check(docs):
    rows = mixing.mix_sources(docs).collect()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    given, sizes = defaultdict(list), defaultdict(int)
    for r in docs.select("doc_id", "text", "source").collect():
        given[r.doc_id].append(words(r.text))
        sizes[r.source] += words(r.text)
    targets, taken = slow_targets(sizes), defaultdict(int)
    assert sorted(((r.doc_id or -1), r.size) for r in rows) == sorted((k or -1, n) for k, v in given.items() for n in v)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(targets[r.source])
        epochs = round(r.target) // r.source_size if r.source_size else 0
        assert epochs * r.size <= r.taken <= min(3, epochs + 1) * r.size
        taken[r.source] += r.taken
    assert {s: n for s, n in taken.items()} == {s: round(targets[s]) for s in sizes}
    assert sorted(map(repr, rows)) == sorted(map(repr, mixing.mix_sources(docs.repartition(5)).collect()))


def test_documents(documents):
    check(documents)


def test_awkward_rows(awkward, nothing):
    check(awkward)
    assert mixing.mix_sources(nothing).count() == 0


def test_one_source_holds_most_rows(spark):
    rows = [(k, "w " * (k % 7), "big" if k % 5 else f"s{k % 4}") for k in range(9_000)]
    check(spark.createDataFrame(rows, "doc_id long, text string, source string"))


def test_better_documents_come_first(spark):
    rows = [(k, ("good words here " if k % 2 else "bad## wo$$rds ||here ") * 5, "a" if k < 4_000 else "b") for k in range(8_000)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).filter("source = 'b'").collect()
    good, bad = (sum(r.taken > 0 for r in got if r.doc_id % 2 == k) for k in (1, 0))
    assert good > 1.5 * bad > 0


def test_no_python_in_the_plan(documents):
    plan = mixing.mix_sources(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
