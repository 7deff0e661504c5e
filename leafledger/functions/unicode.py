"""Unicode helpers. Spark has no NFC and no accent folding, so two small Arrow UDFs
exist; both receive NULL for every value that a native expression can already answer."""

from __future__ import annotations

import re
import sys
import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ASCII = r"^[\x00-\x7F]*$"


@F.pandas_udf(T.StringType())
def _nfc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFC", v), na_action="ignore")


def _runs_of_marks(low: int, high: int) -> re.Pattern:
    return re.compile("[" + "".join(re.escape(chr(c)) for c in range(low, high) if unicodedata.category(chr(c)) == "Mn") + "]+")


# Two patterns, as a set with characters of both kinds is searched one by one.
_MARKS, _HIGH_MARKS = _runs_of_marks(0, 0x10000), _runs_of_marks(0x10000, sys.maxunicode + 1)
_HIGH = re.compile("[\U00010000-\U0010FFFF]")
_FOLD_ROWS = 64


def _strip_marks(text: str) -> str:
    parts = _MARKS.sub("", unicodedata.normalize("NFD", text))
    return (_HIGH_MARKS.sub("", parts) if _HIGH.search(parts) else parts).lower()


@F.arrow_udf(T.StringType())
def _fold(values: pa.Array) -> pa.Array:
    """A few rows at a time are Python strings, the rest of the batch stays in Arrow."""
    parts = [pa.array([], pa.string())]
    for start in range(0, len(values), _FOLD_ROWS):
        rows = values.slice(start, _FOLD_ROWS)
        parts.append(
            pa.nulls(len(rows), pa.string()) if rows.null_count == len(rows)
            else pa.array([None if v is None else _strip_marks(v) for v in rows.to_pylist()], pa.string())
        )
    return pa.concat_arrays(parts)


def nfc(value: Column) -> Column:
    """NFC form; plain ASCII never leaves the JVM."""
    ascii_only = value.rlike(ASCII)
    return F.when(ascii_only, value).otherwise(_nfc(F.when(~ascii_only, value)))


def _latin_table() -> tuple[str, str]:
    """Precomposed Latin letters with an ASCII base and that base, derived from Unicode data."""
    source, target = [], []
    for code in range(0x00C0, 0x0250):
        letter = chr(code)
        base = _strip_marks(letter)
        if base != letter.lower() and len(base) == 1 and base.isascii():
            source.append(letter)
            target.append(base)
    return "".join(source), "".join(target)


_LATIN_FROM, _LATIN_TO = _latin_table()
# ASCII, Latin-1, Latin Extended A/B and general punctuation: the table above is complete there.
_LATIN_ONLY = "^[\\x{0000}-\\x{024F}\\x{2000}-\\x{206F}\\x{20AC}]*$"


def fold(value: Column) -> Column:
    """Search form: NFD without marks, lower case. Latin text is folded natively, ASCII text, known by its length alone, only lowered."""
    ascii_only = F.octet_length(value) == F.char_length(value)
    latin = value.rlike(_LATIN_ONLY)
    native = F.lower(F.translate(value, _LATIN_FROM, _LATIN_TO))
    return F.when(ascii_only, F.lower(value)).when(latin, native).otherwise(_fold(F.when(~ascii_only & ~latin, value)))


def path_key(path: Column) -> Column:
    """Identity of a live path: lower case of the NFC form."""
    return F.lower(nfc(path))


_SUPPLEMENTARY = "[\\x{10000}-\\x{10FFFF}]"


@F.pandas_udf(T.StringType())
def _utf16_slice(text: pd.Series, offset: pd.Series, length: pd.Series) -> pd.Series:
    def cut(value, start, size):
        if value is None or start is None or pd.isna(start):
            return None
        raw = value.encode("utf-16-le")
        begin = int(start) * 2
        end = len(raw) if size is None or pd.isna(size) else begin + int(size) * 2
        return raw[begin:end].decode("utf-16-le", errors="replace")

    return pd.Series([cut(t, o, n) for t, o, n in zip(text, offset, length)])


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 code units: characters plus one for each supplementary character."""
    return (F.char_length(text) + F.regexp_count(text, F.lit(_SUPPLEMENTARY))).cast("long")


def utf16_slice(text: Column, offset: Column, length: Column) -> Column:
    """Slice by UTF-16 units. Only text with supplementary characters reaches Python."""
    wide = text.rlike(_SUPPLEMENTARY)
    size = F.coalesce(length, F.char_length(text)).cast("int")
    native = F.substring(text, (offset + 1).cast("int"), size)
    return F.when(~wide, native).otherwise(
        _utf16_slice(F.when(wide, text), offset.cast("long"), length.cast("long"))
    )
