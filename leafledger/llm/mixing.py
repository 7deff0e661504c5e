"""Mixing sources to target weights: Efraimidis-Spirakis sampling to word budgets, in SQL functions only.

A source's target is its share of all words by weight, held at ``REPEATS`` times its own words; what is
cut off goes to the others by weight (water filling, solved in closed form over the sorted ratios).
A target takes whole epochs of the source first; the rest is a weighted sample without replacement: each
document draws the key ``-ln(u) / quality``, keys are sorted within the source, and documents are taken
in that order until the budget is used up, the last one in part. ``u`` comes from the id's digest, so
reruns agree.

A source's keys are cut into slices of about equal probability at any quality, so no window holds a whole source. NULL text
has size 0; NULL ids share one draw; the NULL source is a source of its own and sorts last. Repeated rows
are documents of their own. Extra columns stay out of the plan (``copies`` keeps the given ones).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage
from .common import word_count

WEIGHTS = [5, 2, 1]
REPEATS = 3
SLICE_ROWS = 4_000


def quality_weight(text: Column) -> Column:
    """Between 0.1 and 1: falls with the share of symbols among the characters."""
    length = F.length(text)
    symbols = length - F.length(F.translate(text, "#*$%&|<>", ""))
    return F.greatest(F.lit(0.1), F.lit(1.0) - F.lit(10.0) * F.coalesce(symbols / F.greatest(length, F.lit(1)), F.lit(0.0)))


def draw(doc_id: Column) -> Column:
    """Uniform in (0, 1) from 52 bits of the id's MD5."""
    bits = F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 13), 16, 10)
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(16**13))


def source_targets(sizes: DataFrame, weights: list[int] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """(source, source_size) to target words per source; one small row per source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("weight", F.element_at(cycle, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.lit(float(repeats)) * F.col("source_size"))
    ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = ratio.rowsBetween(Window.unboundedPreceding, -1), ratio.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    levels = ranked.withColumn("level", level).withColumn("full", F.col("cap") / F.col("weight") <= F.col("level"))
    # Levels rise while sources are cut off and fall behind the first that is not: its level is the water line.
    line = F.max(F.when(~F.col("full"), F.col("level"))).over(Window.partitionBy())
    target = F.least(F.col("cap"), F.coalesce(line, F.lit(float("inf"))) * F.col("weight"))
    return levels.select("source", "source_size", target.alias("target"))


def mix_place(text: str, doc_id: str) -> list[Column]:
    """``key``, ``id`` and ``size``: a document's place in the order of its source."""
    key = -F.log(draw(F.col(doc_id))) / quality_weight(F.col(text))
    return [key.alias("key"), F.col(doc_id).cast("long").alias("id"), word_count(F.col(text)).alias("size")]


def _spread(key: Column) -> Column:
    """Rises with the key from 0 to 1 and gives keys of every quality between 0.1 and 1 a fair part of the way: the mean of their distributions."""
    rates = [0.1, 0.22, 0.46, 1.0]
    return sum((1 - F.exp(-F.lit(r) * key) for r in rates), F.lit(0.0)) / len(rates)


def _placed(docs: DataFrame, copies: list[str], weights: list[int], repeats: int) -> DataFrame:
    """One row per document with its source's plan and ``part``, the words that the fractional selection takes of it."""
    narrow = cut_lineage(docs.select(F.col("source").alias("source"), *mix_place("text", "doc_id"), *[F.col(c).alias(f"_{c}") for c in copies]))
    narrow = narrow.withColumnRenamed("id", "doc_id")
    sizes = narrow.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    targets = source_targets(sizes.select("source", "source_size"), weights, repeats).withColumn("goal", F.round("target").cast("long"))
    size = F.col("source_size")
    plan = targets.select(
        F.col("source").alias("s"), "source_size", "target",
        F.when(size > 0, F.floor(F.col("goal") / size)).otherwise(0).cast("long").alias("epochs"),
        F.when(size > 0, F.col("goal") - F.floor(F.col("goal") / size) * size).otherwise(0).cast("long").alias("rest"),
    )
    plan = plan.join(sizes.select(F.col("source").alias("s2"), "rows"), F.col("s").eqNullSafe(F.col("s2"))).drop("s2")
    joined = narrow.join(plan, narrow["source"].eqNullSafe(plan["s"]), "left").drop("s")
    slices = F.greatest(F.lit(1), F.ceil(F.col("rows") / SLICE_ROWS))
    sliced = joined.withColumn("slice", F.least(F.floor(_spread(F.col("key")) * slices), slices - 1).cast("long"))
    totals = sliced.groupBy("source", "slice").agg(F.sum("size").alias("t"))
    earlier = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("source").alias("s"), F.col("slice").alias("k"), F.coalesce(F.sum("t").over(earlier), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("source", "slice").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sliced.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(offsets, placed["source"].eqNullSafe(offsets["s"]) & (placed["slice"] == offsets["k"]), "left")
    return placed.withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("offset") - F.col("within"))))


def mix_sources(docs: DataFrame, copies: list[str] | None = None, weights: list[int] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """One row per document: its size, its source's size and target, and the words the mix takes of it."""
    copies = copies or []
    return _placed(docs, copies, weights, repeats).select(
        "doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("part")).cast("long").alias("taken"),
        F.col("source"), *[f"_{c}" for c in copies],
    )


def mix_cuts(docs: DataFrame, weights: list[int] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """The mix in one row per source: whole ``epochs`` and ``last``, the place (key, id, size) of the last document that the rest takes words of."""
    place = F.when(F.col("part") > 0, F.struct("key", F.col("doc_id").alias("id"), "size"))
    return _placed(docs, [], weights, repeats).groupBy("source").agg(F.max("epochs").alias("epochs"), F.max(place).alias("last"))


SQL = """
WITH words AS (
  SELECT doc_id, source, text,
    len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> ''))::BIGINT AS size
  FROM documents
), keyed AS (
  SELECT doc_id, source, size,
    -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
      / greatest(0.1, 1.0 - 10.0 * coalesce((length(text) - length(translate(text, '#*$%&|<>', '')))::DOUBLE / greatest(length(text), 1), 0.0)) AS key
  FROM words
), sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM keyed GROUP BY source
), ranked AS (
  SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight, 3.0::DOUBLE * source_size AS cap FROM sizes
), levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM ranked
), targets AS (
  SELECT source, source_size, least(cap, coalesce(max(level) FILTER (cap / weight > level) OVER (), 'inf'::DOUBLE) * weight) AS target FROM levels
), plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS epochs,
    CASE WHEN source_size > 0 THEN round(target)::BIGINT % source_size ELSE 0 END AS rest
  FROM targets
)
SELECT k.doc_id, k.size, p.source_size, p.target, k.source,
  (p.epochs * k.size + greatest(0, least(k.size, p.rest - coalesce(sum(k.size) OVER (
    PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))))::BIGINT AS taken
FROM keyed k JOIN plan p ON k.source IS NOT DISTINCT FROM p.source
"""
