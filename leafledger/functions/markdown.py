"""Markdown headings outside fenced code, and text insertion at the end of a section."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from .unicode import utf16_length

# Line, fence and heading patterns.
_LINE = re.compile(r"[^\r\n]*(\r\n|\n|\r|$)")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})([^\u2028\u2029]*)")
_HEADING = re.compile(r" {0,3}(#{1,6})(?:[ \t]+([^\u2028\u2029]*)|[ \t]*)")

SECTION = T.ArrayType(
    T.StructType(
        [T.StructField(n, T.IntegerType()) for n in ("line_no", "level")]
        + [T.StructField("heading", T.StringType())]
        + [T.StructField(n, T.IntegerType()) for n in ("start", "stop")]
        + [T.StructField("eol", T.StringType())]
    )
)


# White space that ends and starts of a title lose (that of the note format, not Python's).
_BLANK = "\t\n\x0b\x0c\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def _title(raw: str) -> str:
    """Heading text without a closing run of ``#``, which counts as one only behind a blank."""
    kept = raw.rstrip(" \t")
    bare = kept.rstrip("#")
    closed = bare != kept and bare.endswith((" ", "\t"))
    return (bare if closed else kept).strip(_BLANK)


def scan_headings(text: str) -> list[dict]:
    """Headings with the character range of their section.

    A section stops where the next heading of the same or a higher level starts.
    ``eol`` is the last line ending inside the section (a newline if it has none).
    """
    found, open_rows, fence, last_eol = [], [], "", ""
    pos = number = 0
    while pos < len(text):
        match = _LINE.match(text, pos)
        eol = match.group(1)
        line = text[pos : match.end() - len(eol)]
        bar = _FENCE.fullmatch(line)
        if fence:
            if bar and bar.group(1).startswith(fence) and not bar.group(2).strip(_BLANK):
                fence = ""
        elif bar:
            fence = bar.group(1)
        elif head := _HEADING.fullmatch(line):
            level = len(head.group(1))
            while open_rows and open_rows[-1]["level"] >= level:
                row = open_rows.pop()
                row["stop"], row["eol"] = pos, last_eol
            row = {"line_no": number, "level": level, "heading": _title(head.group(2) or ""), "start": pos, "stop": 0, "eol": eol}
            found.append(row)
            open_rows.append(row)
        last_eol = eol or last_eol
        pos, number = match.end(), number + 1
    for row in open_rows:
        row["stop"], row["eol"] = len(text), last_eol if row["eol"] else "\n"
    return found


def insert_under(text: str, heading: str, addition: str) -> str | None:
    """``text`` with ``addition`` at the end of the first section titled ``heading``."""
    wanted = heading.strip(_BLANK)
    section = next((row for row in scan_headings(text) if row["heading"] == wanted), None) if wanted else None
    if section is None:
        return None
    before, behind = text[: section["stop"]], text[section["stop"] :]
    if behind:
        return before + addition + section["eol"] + behind
    glue = "" if before[-1:] in ("\r", "\n") else section["eol"]
    return before + glue + addition


@F.pandas_udf(SECTION)
def _sections(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: scan_headings(t) if t else [])


@F.pandas_udf(T.StringType())
def _insert(texts: pd.Series, headings: pd.Series, additions: pd.Series) -> pd.Series:
    return pd.Series(
        [insert_under(t, h, a) if t and h and a is not None else None for t, h, a in zip(texts, headings, additions)],
        dtype="object",
    )


def _may_have_heading(text: Column) -> Column:
    return text.rlike(r"(?m)^ {0,3}#")


def markdown_sections(df: DataFrame, text: str = "content") -> DataFrame:
    """One row per heading. Text without any ``#`` line never leaves the JVM."""
    keep = [c for c in df.columns if c != text]
    return (
        df.filter(_may_have_heading(F.col(text)))
        .select(*keep, F.explode(_sections(F.col(text))).alias("s"))
        .select(*keep, "s.line_no", "s.level", "s.heading", "s.start", "s.stop")
    )


def append_under_heading(df: DataFrame, text_limit: int = K.INLINE_TEXT_LIMIT) -> DataFrame:
    """Columns ``content``, ``heading``, ``addition`` → ``new_content`` or a ``reason``; longer than ``text_limit`` bytes is refused."""
    candidate = F.when(_may_have_heading(F.col("content")), F.col("content"))
    out = df.withColumn("new_content", _insert(candidate, F.col("heading"), F.col("addition")))
    large = F.octet_length("new_content") > text_limit
    out = out.withColumn("reason", F.when(F.col("new_content").isNull(), "heading_not_found").when(large, "text_too_large"))
    return out.withColumn("new_content", F.when(F.col("reason").isNull(), F.col("new_content")))


__all__ = ["append_under_heading", "insert_under", "markdown_sections", "scan_headings", "utf16_length"]
