import itertools
import re
from collections import Counter, defaultdict

import pytest

from leafledger.llm import filter_audit


def slow(rows, labels):
    """The audit by walking every document through every order."""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    first = {}
    for doc_id, text, _ in rows:
        if doc_id is not None:
            first[text or ""] = min(first.get(text or "", doc_id), doc_id)
    fails = []
    for doc_id, text, lang in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        failed = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            "D": bool(re.search("[#$%&*|]", text)), "E": doc_id is not None and doc_id > first[text],
        }
        fails.append((lang or "", doc_id, {f for f, v in failed.items() if v}))
    out, shapley = {}, Counter()
    for order in map("".join, itertools.permutations("ABCDE")):
        sums = defaultdict(Counter)
        for part, doc_id, failed in fails:
            gone = False
            for step, f in enumerate(order, 1):
                s = sums[part, step]
                s.update(kept=not gone and f not in failed, removed=not gone and f in failed, redundant=gone and f in failed, unique=failed == {f})
                if not gone and f in failed:
                    s.update(good=doc_id in good, toxic=doc_id in toxic)
                    shapley[part, f] += 1
                    gone = True
        for (part, step), s in sums.items():
            out[part, order, step] = [s[k] for k in ("kept", "removed", "redundant", "unique", "good", "toxic")]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited(spark, docs, labels, **more):
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int") if isinstance(labels, list) else labels
    got = filter_audit.audit_filters(docs, table, **more).collect()
    rows = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got}
    assert len(rows) == len(got)
    return rows


LABELS = [(1, 1, 0), (1, 0, 1), (6, 1, None), (6, 1, 1), (None, 1, 1), (5, 0, 1), (10, None, 1), (99, 1, 1)]


def test_awkward_rows_by_brute_force(spark, awkward):
    rows = [(r.doc_id, r.text, r.lang) for r in awkward.collect()]
    assert audited(spark, awkward, LABELS) == slow(rows, LABELS)


@pytest.mark.parametrize("most", [filter_audit.MOST_COUNTERS, 1])
def test_documents_by_brute_force_also_with_a_full_sketch(spark, documents, most):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    rows = [(r.doc_id, r.text, r.lang) for r in documents.collect()]
    known = [tuple(r) for r in labels.select("doc_id", "quality", "toxic").collect()]
    assert audited(spark, documents, labels, most_counters=most) == slow(rows, known)


def test_one_text_on_a_third_of_the_rows_and_repeated_ids(spark):
    rows = [(k, "same # text" if k % 3 == 0 else f"text {k % 40}", "en" if k % 2 else None) for k in range(600)] + [(3, "same # text", "en")] * 5 + [(7, "x", "en"), (7, "y", "en"), (None, "x", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(7)
    assert audited(spark, docs, []) == slow(rows, [])


def test_empty_table_and_a_very_long_text(spark, nothing):
    assert audited(spark, nothing, LABELS) == {}
    long = "Word1 wörd2 word3 " * 600_000 + "x" * 3_000_000
    rows = [(1, long, "en"), (2, long, "en"), (3, long + "#", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert audited(spark, docs, []) == slow(rows, [])


def test_words_of_long_texts_are_never_cut():
    raw = b"ab cde\tf " * 400_000 + b"z" * 2_500_000 + b" end"
    assert [w for some in filter_audit._word_lists(raw) for w in some] == raw.split()
