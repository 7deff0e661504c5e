"""URL filters: a sort-merge range join of canonical host keys with allow and block rules.

A host's key is its labels in reverse order, each closed by a dot, so a rule's host is the prefix of
its own and all subdomains' keys: an interval. Rows are dealt to ranges of (key, row hash) whose
bounds come from a bounded sample (it decides balance, never results); a rule goes to every range that
its interval meets. Each range is sorted and swept once, with a stack of the rules whose interval is
open. The longest open rule whose path starts the URL's path wins (host length plus path length, then
block before allow).

NULL URLs and URLs without ``://`` have an empty host and path and meet no rule. Rows without a rule
get ``default`` as verdict. Equal rules count once. Repeated rows and NULL ids are kept; other columns
of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii

SAMPLE = 4_000
DEFAULT_VERDICT = "allow"
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def url_host(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?`` or ``#``, A-Z lowered; empty without ``://``."""
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0))).otherwise(F.lit(""))


def url_path(url: Column) -> Column:
    """From the end of the host to the next ``?`` or ``#``."""
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def host_key(host: Column) -> Column:
    """``www.example.com`` becomes ``com.example.www.``; an empty host stays empty."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def rule_frame(spark, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules as (verdict, host, path) rows."""
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def _place(bounds: list[str]):
    edges = np.array([b.encode() for b in bounds], dtype=object)

    @F.pandas_udf("int")
    def place(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, np.array([k.encode() for k in keys], dtype=object), side="right"))

    return place


def _sweep(default: str):
    def sweep(batches):
        slot, stack = None, []  # stack: (key, path, rule, verdict) of open rules, outermost first
        for batch in batches:
            rows = batch.to_pydict()
            rule_out, verdict_out, keep = [], [], []
            for at, (own, key, kind, path) in enumerate(zip(rows["slot"], rows["key"], rows["kind"], rows["path"])):
                if own != slot:
                    slot, stack = own, []
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if kind == 0:
                    stack.append((key, path, rows["rule"][at], rows["verdict"][at]))
                    continue
                best = max(
                    ((len(r[2]), r[3] == "block", r) for r in stack if path.startswith(r[1])), default=None, key=lambda b: b[:2]
                )
                rule_out.append(best and best[2][2])
                verdict_out.append(best[2][3] if best else default)
                keep.append(at)
            kept = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [kept.column("page_id"), kept.column("host"), kept.column("path"), pa.array(rule_out, pa.string()), pa.array(verdict_out, pa.string())],
                ["page_id", "host", "path", "rule", "verdict"],
            )

    return sweep


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = DEFAULT_VERDICT, sample: int = SAMPLE) -> DataFrame:
    """One row per page: host, path, the rule that holds and its verdict."""
    spark = pages.sparkSession
    slots = 4 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    url = F.col("url").cast("string")
    mark = F.lpad(F.hex(F.xxhash64("page_id", "url")), 16, "0")
    cut = pages.select(F.col("page_id").cast("long").alias("page_id"), url_host(url).alias("host"), url_path(url).alias("path"), mark.alias("mark"))
    # The mark spreads one host's rows over ranges; \x01 sorts below every label, so a rule precedes its host's rows.
    keyed = cut.select("page_id", "host", "path", host_key(F.col("host")).alias("key"), "mark")
    order = F.concat("key", F.lit("\x01"), "mark")
    total = keyed.count()
    place_of = F.pmod(F.xxhash64("order"), F.lit(max(total, 1)))
    seen = keyed.select(order.alias("order")).filter(place_of < 2 * sample).limit(4 * sample)
    found = sorted(row.order for row in seen.collect())  # about twice ``sample`` keys
    bounds = sorted({found[len(found) * i // slots] for i in range(1, slots)}) if found else []
    place = _place(bounds)
    known = rules.select(
        F.col("verdict"), lower_ascii(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path")
    ).filter("host IS NOT NULL AND host <> ''").dropDuplicates()
    ends = known.withColumn("key", host_key(F.col("host"))).select("*", place(F.col("key")).alias("low"), place(F.concat(F.expr("left(key, length(key) - 1)"), F.lit("/"))).alias("high"))
    open_rules = ends.select(
        F.explode(F.sequence("low", "high")).alias("slot"), "key", F.lit(0).alias("kind"), F.lit("").alias("mark"), F.lit(None).cast("long").alias("page_id"),
        "host", "path", F.concat("host", "path").alias("rule"), "verdict",
    )
    rows = keyed.select(
        place(order).alias("slot"), "key", F.lit(1).alias("kind"), "mark", "page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict")
    )
    dealt = rows.unionByName(open_rules).repartition("slot").sortWithinPartitions("slot", "key", "kind", "mark")
    return dealt.mapInArrow(_sweep(default), "page_id long, host string, path string, rule string, verdict string")


SQL = """
WITH cut AS (
  SELECT page_id, row_number() OVER () AS n, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, n,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), rules(verdict, r_host, r_path) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
    ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), hits AS (
  SELECT p.page_id, p.n, p.host, p.path, r.r_host || r.r_path AS rule, r.verdict
  FROM parts p LEFT JOIN rules r
    ON (p.host = r.r_host OR ends_with(p.host, '.' || r.r_host)) AND starts_with(p.path, r.r_path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM hits
QUALIFY row_number() OVER (PARTITION BY n ORDER BY length(rule) DESC NULLS LAST) = 1
"""
