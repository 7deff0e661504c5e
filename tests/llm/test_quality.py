import re
from collections import Counter

import pytest

from leafledger.llm import quality

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_base(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    found = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    inside = {p for k in range(len(words) - 2) if found[tuple(words[k : k + 3])] > 1 for p in (k, k + 1, k + 2)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


@pytest.fixture(scope="module")
def judged(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    return quality.quality_rules(docs, labels).collect(), {r.doc_id: r for r in labels.collect()}, {r.doc_id: r.text for r in docs.collect()}


def test_base_counts_equal_brute_force(judged):
    rows, _, texts = judged
    for r in rows:
        want = slow_base(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)


def test_model_agrees_with_labels(judged):
    rows, labels, _ = judged
    known = [(r.kept, labels[r.doc_id].quality) for r in rows if not r.base_failed and r.doc_id in labels]
    assert sum(kept == bool(good) for kept, good in known) > 0.97 * len(known)
    assert len({kept for kept, _ in known}) == 2


def test_awkward_rows(spark, awkward, nothing):
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0)], "doc_id long, quality int")
    rows = quality.quality_rules(awkward, labels).collect()  # one kind of label: the base rules decide
    assert len(rows) == awkward.count()
    assert all(r.kept == (not r.base_failed) for r in rows)
    assert next(r for r in rows if r.doc_id == 2).n_words == 0
    assert quality.quality_rules(nothing, labels).count() == 0
    assert quality.quality_rules(awkward, labels.limit(0)).count() == awkward.count()


def test_long_texts_alone_are_learned_from(spark):
    """Every labelled text is above the fit's length; what tells them apart lies at their ends."""
    lines = {1: "the river runs past quiet fields", 0: "click here buy now free offer"}
    rows = [(k, f"start {k} " * 20 + f"{lines[k % 2]} w{k} " * 60) for k in range(60)]
    docs = spark.createDataFrame([*rows, (7, rows[7][1]), (None, "x")], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int")
    model = quality.fit_quality(docs, labels, fit_chars=400)
    assert model == quality.fit_quality(docs.repartition(5), labels, fit_chars=400)
    chances = {r.doc_id: r.quality for r in quality.judge_quality(docs, model).collect()}
    assert min(chances[k] for k in range(1, 60, 2)) > max(chances[k] for k in range(0, 60, 2))


def test_grams_are_of_characters():
    """One more byte per letter leaves as many grams; those of one text do not reach into the next."""
    for texts in (["abcdef", "xyz"], ["\u00e4bcd\u00e9f", "\u00fcyz"]):
        found = quality.gram_buckets([t.encode() for t in texts], [[t.encode()] for t in texts])
        assert [(end - start).tolist() for _, start, end in found] == [[4, 1], [3, 0], [2, 0], [1, 1], [0, 0]]
