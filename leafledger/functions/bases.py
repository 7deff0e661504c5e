"""Structural check of Base files (YAML): a batch job over all of them.

PyYAML reads the events; the shape rules are below. Text over the byte limit is
rejected natively and never reaches Python.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Limits of the check and its messages.
MAX_BYTES = 65_536
MAX_DEPTH = 32
MAX_NODES = 16_384
TOO_LARGE = "Base YAML exceeds 65536 UTF-8 bytes"
ONE_DOCUMENT = "Base YAML must contain one document"
BAD_SYNTAX = "Base YAML syntax is invalid"
BAD_SHAPE = "Base structure is invalid"

VERDICT = T.StructType([T.StructField("valid", T.BooleanType()), T.StructField("diagnostics", T.ArrayType(T.StringType()))])


def _text_map(value) -> bool:
    return isinstance(value, dict) and all(isinstance(v, str) for v in value.values())


def _text_list(value) -> bool:
    return isinstance(value, list) and all(isinstance(v, str) for v in value)


def _filter(value) -> bool:
    if isinstance(value, str):
        return True
    if not isinstance(value, dict):
        return False
    used = [value[k] for k in ("and", "or", "not") if k in value]
    return len(used) == 1 and isinstance(used[0], list) and bool(used[0]) and all(map(_filter, used[0]))


def _group_by(value) -> bool:
    return isinstance(value, dict) and isinstance(value.get("property"), str) and value.get("direction") in ("ASC", "DESC")


_VIEW = {
    "name": lambda v: isinstance(v, str), "filters": _filter, "formulas": _text_map, "properties": _text_list,
    "summaries": _text_map, "groupBy": _group_by, "order": _text_list,
    "groupOrder": lambda v: isinstance(v, list) and all(x is None or isinstance(x, str) for x in v),
}


def _view(value) -> bool:
    return isinstance(value, dict) and isinstance(value.get("type"), str) and all(f(value[k]) for k, f in _VIEW.items() if k in value)


_ROOT = {
    "filters": _filter, "formulas": _text_map, "properties": lambda v: isinstance(v, dict), "summaries": _text_map,
    "views": lambda v: isinstance(v, list) and all(map(_view, v)),
}


def _diagnose(text: str) -> str | None:
    import yaml

    documents = nodes = depth = 0
    keys: list[list] = []
    try:
        for event in yaml.parse(text, Loader=yaml.SafeLoader):
            if isinstance(event, yaml.AliasEvent) or getattr(event, "anchor", None):
                return "YAML anchors are not supported"
            if getattr(event, "tag", None):
                return "YAML tags are not supported"
            documents += isinstance(event, yaml.DocumentStartEvent)
            nodes += isinstance(event, yaml.NodeEvent)
            depth += isinstance(event, yaml.CollectionStartEvent) - isinstance(event, yaml.CollectionEndEvent)
            if depth > MAX_DEPTH or nodes > MAX_NODES:
                return "YAML node limit exceeded"
        if documents != 1:
            return ONE_DOCUMENT
        root = yaml.compose(text, Loader=yaml.SafeLoader)
        stack = [root]
        while stack:
            node = stack.pop()
            if isinstance(node, yaml.MappingNode):
                names = [k.value for k, _ in node.value if isinstance(k, yaml.ScalarNode)]
                if len(names) != len(set(names)):
                    return BAD_SYNTAX
                stack += [child for pair in node.value for child in pair]
            elif isinstance(node, yaml.SequenceNode):
                stack += node.value
        value = yaml.load(text, Loader=yaml.SafeLoader)
    except (yaml.YAMLError, ValueError, RecursionError):
        return BAD_SYNTAX
    if not isinstance(value, dict) or not all(f(value[k]) for k, f in _ROOT.items() if k in value):
        return BAD_SHAPE
    return None


@F.pandas_udf(VERDICT)
def _verdicts(texts: pd.Series) -> pd.DataFrame:
    found = [None if t is None else _diagnose(t) for t in texts]
    return pd.DataFrame({"valid": [d is None for d in found], "diagnostics": [[] if d is None else [d[:256]] for d in found]})


def validate_bases(df: DataFrame, text: str = "content") -> DataFrame:
    """Adds ``valid`` and ``diagnostics``; the text itself is not returned."""
    small = F.octet_length(text) <= MAX_BYTES
    keep = [c for c in df.columns if c != text]
    judged = df.select(*keep, small.alias("_small"), _verdicts(F.when(small, F.col(text))).alias("_v"))
    return judged.select(
        *keep,
        F.when(F.col("_small"), F.col("_v.valid")).otherwise(F.lit(False)).alias("valid"),
        F.when(F.col("_small"), F.col("_v.diagnostics")).otherwise(F.array(F.lit(TOO_LARGE))).alias("diagnostics"),
    )
