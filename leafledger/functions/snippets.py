"""Snippets: the window of a note's text that shows most hits of a phrase.

Hits are found in the folded text, the window is cut from the original one. Folding drops marks and may lengthen a character, so
positions go through a map of folded lengths, character by character. Only ranked rows come here, a page of results
per query, in Arrow batches.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .unicode import _strip_marks

TOKENS = 64  # of three characters each, so a window has two characters more
MOST_POINTS = 1_024
# Characters up to here fold to one character each, but for marks.
_PLAIN = re.compile("[\\x00-\\u02FF\\u2000-\\u206F\\u20AC]*")


def best_window(folded: str, phrase: str, width: int) -> int:
    """Start of the window of ``width`` characters with most hits of ``phrase``; the first of equal ones, 0 without a hit.

    A window stands around one of the hits, as much text before it as behind it.
    """
    hits, at = [], folded.find(phrase) if phrase else -1
    while at >= 0:
        hits.append(at)
        at = folded.find(phrase, at + 1)
    spare = max(width - len(phrase), 0)
    best, most = 0, 0
    for hit in hits:
        start = max(hit - spare // 2, 0)
        inside = bisect_right(hits, start + spare) - bisect_left(hits, start)
        if inside > most:
            best, most = start, inside
    return best


def original_span(content: str, start: int, end: int) -> tuple[int, int]:
    """The part of the original text that folds to ``start`` to ``end`` of the folded one, with the marks behind it."""
    plain = _PLAIN.match(content).end()
    if end < plain or plain == len(content):
        return start, end
    # The first character whose folded form goes beyond a place is the one that stands there.
    low, reached, known = start if start < plain else None, plain, {}
    for at in range(plain, len(content)):
        character = content[at]
        size = known.get(character)
        if size is None:
            size = known[character] = len(_strip_marks(character))
        reached += size
        if low is None and reached > start:
            low = at
        if reached > end:
            return low, at
    return len(content) if low is None else low, len(content)


def cut_snippet(content: str, folded: str, phrase: str, tokens: int = TOKENS) -> str:
    width = tokens + 2
    start = best_window(folded, phrase, width)
    end = min(start + width, len(folded))
    low, high = original_span(content, start, end)
    if start == 0:
        low = 0
    if end == len(folded):
        high = len(content)
    return (("…" if start else "") + content[low:high] + ("…" if end < len(folded) else ""))[:MOST_POINTS]


@F.arrow_udf(T.StringType())
def _snippets(content: pa.Array, folded: pa.Array, phrase: pa.Array) -> pa.Array:
    """One row's texts at a time are Python strings, the rest of the batch stays in Arrow."""
    rows = zip(content, folded, phrase)
    return pa.array([cut_snippet(c.as_py(), f.as_py(), p.as_py()) if c.is_valid and f.is_valid and p.is_valid else None for c, f, p in rows], pa.string())


def snippet(content: Column, folded: Column, phrase: Column) -> Column:
    """At most 64 tokens with most hits, ``…`` at cut ends, at most 1,024 code points; NULL if an argument is NULL."""
    return _snippets(content, folded, phrase)
