import re
from collections import Counter

import pytest

import corpus_pipeline
from leafledger.llm.common import stored
from leafledger.llm.quality import quality_rules
from test_ngram_join import slow as slow_join
from test_secrets import slow as slow_secrets

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def frames(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out.append(stored(stage(spark, out[-1], SF), f"test-stage-{k}"))
    return out


def rows_of(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns(frames):
    for df in frames[:-1]:
        assert df.columns == corpus_pipeline.COLUMNS


def test_quality_rejects_go(spark, frames):
    verdict = quality_rules(frames[0], spark.read.parquet(f"{SF}/labels.parquet")).filter("kept").collect()
    assert set(rows_of(frames[1])) == {r.doc_id for r in verdict}


def test_one_of_each_group_stays(frames):
    before = rows_of(frames[1])
    want = {c for _, _, c in slow_join([(i, r.text) for i, r in sorted(before.items())])}
    assert set(rows_of(frames[2])) == want and len(want) < len(before)


def test_one_row_of_each_group_stays_whatever_the_ids(spark):
    one, two, three, four = (" ".join(f"{c}{k}" for k in range(40)) for c in "abcd")
    rows = [
        (5, one), (5, one), (6, one + " more"),  # repeated rows, the smallest id among them
        (None, two), (None, two), (None, two + " more"),  # no ids at all
        (None, three), (9, three), (8, three + " more"),  # some ids
        (6, four), (7, None), (7, None), (None, ""),  # an id shared with a loser; nothing to link
    ]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.keep_one_copy(spark, docs.repartition(3), SF).collect()
    unlinked = [(6, four), (7, None), (7, None), (None, "")]
    got = Counter((r.doc_id, r.text) for r in left)
    no_id = [t for t in (two, two + " more") if got[(None, t)]]
    assert len(no_id) == 1
    assert got == Counter([(5, one), (None, no_id[0]), (8, three + " more"), *unlinked])


def test_secrets_are_masked_and_nothing_else(frames):
    before, after = rows_of(frames[2]), rows_of(frames[3])
    assert before.keys() == after.keys()
    changed = 0
    for i, r in before.items():
        if slow_secrets(r.text):
            changed += 1
            assert not slow_secrets(after[i].text) and after[i].n_chars == len(after[i].text)
        elif not re.search("gh[pousr]_|xox|AIza|eyJ|BEGIN", r.text):
            assert after[i].text == r.text
    assert changed


def test_mix_meets_targets(frames):
    from test_mixing import slow_targets

    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, largest = Counter(), Counter()
    for r in frames[3].collect():
        sizes[r.source] += words(r.text)
        largest[r.source] = max(largest[r.source], words(r.text))
    mixed = Counter()
    for r in frames[4].collect():
        mixed[r.source] += words(r.text)
    for source, target in slow_targets(sizes).items():
        assert target - 1 <= mixed[source] <= target + largest[source] + 1


def test_packing_covers_the_mix(spark, frames):
    pieces = Counter()
    for r in frames[5].collect():
        pieces[r.doc_id] += r.length
    assert set(pieces) == {r.doc_id for r in frames[4].collect()}


def test_run_equals_the_stages(spark, frames):
    assert corpus_pipeline.run(spark, SF).count() == frames[5].count()
