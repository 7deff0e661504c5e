import hashlib

import pytest

from leafledger.llm import spotsigs


def slow_print(text):
    import re

    plain = re.sub(r"[^\w]+|_+", " ", text.lower()).strip()
    words = plain.split(" ")
    found, started, pending = set(), False, []
    runs, run = [], []
    for word in words:
        if word in spotsigs.ANCHORS:
            if started and run:
                runs.append(run)
            started, run = True, []
        elif started:
            run.append(word)
    if run:
        runs.append(run)
    for k, r in enumerate(runs):
        chain = (r[:2] + (runs[k + 1][:2] if k + 1 < len(runs) else []))[:2]
        found.add(hashlib.md5(" ".join(chain).encode()).hexdigest()[:8])
    return sorted(found) or [hashlib.md5(plain.encode()).hexdigest()[:8]]


def jaccard(a, b):
    a, b = set(a), set(b)
    return len(a & b) / len(a | b)


def check(docs):
    rows = sorted(((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]), reverse=True)
    want = []
    for k, (doc_id, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        n, h = len(text), len(text) // 2
        edited = text[: n - h] + after[:h]
        own, new = slow_print(text), slow_print(edited)
        want.append((doc_id, n, hashlib.sha256(edited.encode()).hexdigest(), ",".join(own), ",".join(new), round(jaccard(own, new), 9), round(jaccard(own, slow_print(after)), 9)))
    got = [(*tuple(r)[:5], round(r.near_edited, 9), round(r.near_next, 9)) for r in spotsigs.fingerprints(docs).collect()]
    order = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    assert sorted(got, key=order) == sorted(want, key=order)


def test_documents(documents):
    check(documents)


def test_awkward_rows(awkward, nothing):
    check(awkward)
    assert spotsigs.fingerprints(nothing).count() == 0


def test_one_document_is_its_own_neighbour(spark):
    row = spotsigs.fingerprints(spark.createDataFrame([(5, "the big house of the old man")], "doc_id long, text string")).first()
    assert row.near_next == 1.0 and row.n_chars == 28


def test_no_python_in_the_plan(documents):
    plan = spotsigs.fingerprints(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


@pytest.mark.parametrize("sizes", [(1, 11), (3, 100), (9, 100)])
def test_likeness_of_sets_of_unlike_sizes_is_the_true_one(spark, sizes):
    a, b = (",".join(f"{k:08x}" for k in range(n)) for n in sizes)
    from pyspark.sql import functions as F

    row = spark.createDataFrame([(a, b)], "a string, b string").select(spotsigs.likeness(F.col("a"), F.col("b")).alias("x")).first()
    assert row.x == sizes[0] / sizes[1]
