"""Snippet windows: most hits, accented and combining text, bounds."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from leafledger.functions.snippets import best_window, cut_snippet, snippet
from leafledger.functions.unicode import _strip_marks, fold

FILLER = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore "


def slow_window(folded, phrase, width):
    """Every hit's window counted by hand."""
    hits = [i for i in range(len(folded)) if phrase and folded.startswith(phrase, i)]
    spare = max(width - len(phrase), 0)
    starts = [max(h - spare // 2, 0) for h in hits]
    counts = [sum(s <= h <= s + spare for h in hits) for s in starts]
    return starts[counts.index(max(counts))] if hits else 0


@pytest.mark.parametrize("text", [FILLER + "needle " + FILLER * 2 + "needle needle xx needle " + FILLER, "needleneedle", "aaaaaaaaaaaa" * 20, FILLER, "x" * 300 + "needle" * 30])
@pytest.mark.parametrize("phrase", ["needle", "aaa", "e", ""])
def test_window_with_most_hits(text, phrase):
    assert best_window(text, phrase, 66) == slow_window(text, phrase, 66)


def test_dense_hits_win_over_the_first_one():
    text = FILLER + "needle " + FILLER * 3 + "needle needle needle " + FILLER
    out = cut_snippet(text, text, "needle")
    assert out.count("needle") == 3 and out.startswith("…") and out.endswith("…") and len(out) == 68


@pytest.mark.parametrize("form", ["NFC", "NFD"])
def test_the_window_is_cut_from_the_original(form):
    plain = FILLER + "señor été niño " + FILLER
    content = unicodedata.normalize(form, plain)
    out = cut_snippet(content, _strip_marks(content), "senor ete")
    same = cut_snippet(plain, _strip_marks(plain), "senor ete")
    assert unicodedata.normalize("NFC", out) == same and "señor été" in same and out in "…" + content + "…" or out.strip("…") in content


def test_characters_that_fold_to_several():
    content = "한국어 문서 " * 30 + "needle" + " 끝" * 40
    folded = _strip_marks(content)
    assert len(folded) > len(content)
    out = cut_snippet(content, folded, "needle")
    assert "needle" in out and out.strip("…") in content and len(_strip_marks(out.strip("…"))) <= 66 + 2


def test_long_runs_of_marks_are_bounded():
    content = "needle" + "́" * 1_600 + " tail"
    out = cut_snippet(content, _strip_marks(content), "needle")
    assert len(out) <= 1_024 and out.startswith("needle") and out != content
    behind = "́" * 50 + "abc needle"
    assert cut_snippet(behind, _strip_marks(behind), "needle") == behind


def test_phrase_longer_than_the_window_and_short_texts():
    text = "ab" * 100
    assert cut_snippet(text, text, text) == text[:66] + "…"
    assert cut_snippet("abc", "abc", "abc") == "abc" and cut_snippet("", "", "abc") == ""


def test_column_form_with_nulls(spark):
    rows = [("Señor x", "senor"), (None, "a"), ("text", None)]
    out = spark.createDataFrame(rows, "content string, phrase string").select(snippet(F.col("content"), fold(F.col("content")), F.col("phrase")).alias("s")).collect()
    assert [r.s for r in out] == ["Señor x", None, None]


def test_worker_functions_hold_no_batch_of_strings_and_travel_by_value():
    """Arrow in and out, one row at a time; the folder that holds this package need not be on a worker's path."""
    import pickletools

    from pyspark import cloudpickle
    from pyspark.util import PythonEvalType

    from leafledger.functions import snippets, unicode

    for function in (snippets._snippets, unicode._fold):
        assert function.evalType == PythonEvalType.SQL_SCALAR_ARROW_UDF
        ops = list(pickletools.genops(cloudpickle.dumps(function.func)))
        named = [(ops[i - 4][1], ops[i - 2][1]) for i, (op, _, _) in enumerate(ops) if op.name == "STACK_GLOBAL" and i > 3]
        assert not any(str(part).startswith("leafledger") for pair in named for part in pair)


def test_spans_in_mixed_text_equal_a_map_of_every_character():
    import random
    from bisect import bisect_right
    from itertools import accumulate

    from leafledger.functions.snippets import original_span

    rng = random.Random(2)
    for _ in range(300):
        content = "".join(rng.choice("abé́한½😀ﬁ") for _ in range(rng.randrange(30)))
        reached = list(accumulate(len(_strip_marks(c)) for c in content))
        start = rng.randrange(20)
        end = start + rng.randrange(20)
        if end <= (reached[-1] if reached else 0):
            assert original_span(content, start, end) == (bisect_right(reached, start), bisect_right(reached, end))


def test_marks_are_those_of_their_category():
    for text in ["éa", "निं्", "x\U000E0100y\U0001E8D0", "ΑΣ", "İ한"]:
        parts = unicodedata.normalize("NFD", text)
        assert _strip_marks(text) == "".join(c for c in parts if unicodedata.category(c) != "Mn").lower()
