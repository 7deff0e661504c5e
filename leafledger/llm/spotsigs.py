"""Document fingerprints by spot signatures, in SQL functions only.

A spot is a common word; its signature is the chain of the next ``CHAIN`` content words, further common
words skipped. A document's fingerprint is the sorted set of its signatures (eight hex digits each). A
text without a common word gets one signature over all its words, so equal texts always have equal
fingerprints. Likeness is the Jaccard of two sets, whatever their lengths. Sets also carry a band of length: sets more
than one band apart are always less alike than ``FLOOR``.

NULL text is an empty text. NULL ids sort below all others, equal ids by their texts. Repeated rows are
documents of their own. A single document is its own neighbour. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CHAIN = 2
FLOOR = 0.1
# Common words of the four languages.
COMMON = (
    "the of and to in is that it was for on are as with at by an be this from a "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch "
    "de la le et les des en un du une que est pour qui dans par sur au pas plus "
    "el los del se las por con no una su para lo como más o y "
).split()
ANCHORS = sorted(set(COMMON))


def plain_words(text: Column) -> Column:
    """Lower-case letters and digits, one space between words."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def spot_set(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds the fingerprint of column ``text`` as ``out``."""
    mark = "\x01"
    marked = F.array_join(F.transform(F.split("_plain", " "), lambda w: F.when(w.isin(*ANCHORS), F.lit(mark)).otherwise(w)), " ")
    # What follows each common word; a run that is empty (two common words in a row) adds nothing.
    behind = F.split(marked, mark)
    runs = F.filter(
        F.transform(F.slice(behind, 2, F.greatest(F.size(behind), F.lit(1))), lambda s: F.substring_index(F.trim(s), " ", CHAIN)), lambda s: s != ""
    )
    following = F.slice("_runs", 2, F.greatest(F.size("_runs"), F.lit(1)))
    chains = F.zip_with("_runs", following, lambda a, b: F.substring_index(F.concat_ws(" ", a, b), " ", CHAIN))
    hashed = F.array_sort(F.array_distinct(F.transform(chains, lambda c: F.substring(F.md5(c), 1, 8))))
    whole = F.substring(F.md5(F.col("_plain")), 1, 8)
    return (
        df.withColumn("_plain", plain_words(F.col(text)))
        .withColumn("_runs", runs)
        .withColumn(out, F.when(F.size("_runs") > 0, F.array_join(hashed, ",")).otherwise(whole))
        .drop("_plain", "_runs")
    )


def likeness(one: Column, other: Column) -> Column:
    """Jaccard of two fingerprints."""
    a, b = (F.length(one) + 1) / 9, (F.length(other) + 1) / 9  # eight digits and a comma each
    shared = F.size(F.array_intersect(F.split(one, ","), F.split(other, ",")))
    return F.when(one == other, F.lit(1.0)).otherwise(shared / (a + b - shared))


def length_band(fingerprint: Column, floor: float = FLOOR) -> Column:
    """Sets more than one band apart are always below ``floor``."""
    return F.floor(F.log((F.length(fingerprint) + 1) / 9) / F.log(F.lit(1 / floor))).cast("int")


def with_next(docs: DataFrame) -> DataFrame:
    """Each document with text and fingerprint of the next one in descending ``doc_id`` order.

    Ids are cut into ranges at approximate quantiles. The neighbour across a range's edge is the last
    row of the range below (the highest of all for the lowest), put into the range as a ghost row.
    """
    spark = docs.sparkSession
    slots = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    steps = F.array(*[F.lit(k / slots) for k in range(1, slots)])
    cuts = base.agg(F.percentile_approx("doc_id", steps, F.lit(10 * slots))).first()[0] or []
    edges = F.array(*[F.lit(c) for c in sorted(set(cuts))]).cast("array<long>")
    slot = F.coalesce(F.size(F.filter(edges, lambda e: e < F.col("doc_id"))), F.lit(0))
    base = base.withColumn("slot", F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(slot))
    last = base.groupBy("slot").agg(F.max("doc_id").alias("last"))  # one row per range
    order = Window.orderBy("slot")
    ring = Window.partitionBy()
    ghosts = last.select(
        F.col("slot").alias("own"), "last", F.coalesce(F.lead("slot").over(order), F.min("slot").over(ring)).alias("slot")
    )
    tops = base.withColumnRenamed("slot", "own").join(F.broadcast(ghosts), "own")  # at most one row per range
    tops = tops.filter(F.col("doc_id").eqNullSafe(F.col("last"))).groupBy("slot").agg(F.max("text").alias("text"), F.max("doc_id").alias("doc_id"))
    rows = base.withColumn("ghost", F.lit(0)).unionByName(tops.select("doc_id", "text", "slot", F.lit(1).alias("ghost")))
    inside = Window.partitionBy("slot").orderBy(F.col("ghost").desc(), F.col("doc_id").asc_nulls_first(), "text")
    printed = spot_set(rows, "text", "fingerprint")
    placed = printed.withColumns({"next_text": F.lag("text").over(inside), "next_fingerprint": F.lag("fingerprint").over(inside)})
    return placed.filter("ghost = 0").drop("ghost", "slot")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited form, and how alike they are."""
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.expr("substring(text, 1, n_chars - floor(n_chars / 2))"), F.substring("next_text", 1, half))
    rows = with_next(docs).withColumn("n_chars", F.length("text").cast("int")).withColumn("edited", edited)
    rows = spot_set(rows.select("doc_id", "n_chars", "fingerprint", "next_fingerprint", "edited"), "edited", "edited_fingerprint")
    return rows.select(
        "doc_id", F.col("n_chars").cast("long").alias("n_chars"), F.sha2(F.col("edited"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
        length_band(F.col("fingerprint")).alias("length_band"),
    )


def _sql_print(text: str) -> str:
    words = ", ".join(f"'{w}'" for w in ANCHORS)
    return f"""
    SELECT *, CASE WHEN len(runs) = 0 THEN substr(md5(plain), 1, 8) ELSE array_to_string(list_sort(list_distinct(list_transform(range(1, len(runs) + 1),
        lambda i: substr(md5(array_to_string(string_split(runs[i] || CASE WHEN i < len(runs) THEN ' ' || runs[i + 1] ELSE '' END, ' ')[1:2], ' ')), 1, 8)))), ',') END AS print
    FROM (SELECT *, list_filter(list_transform(string_split(array_to_string(list_transform(string_split(plain, ' '),
        lambda w: CASE WHEN w IN ({words}) THEN chr(1) ELSE w END), ' '), chr(1))[2:],
        lambda s: array_to_string(string_split(trim(s), ' ')[1:2], ' ')), lambda s: s <> '') AS runs
      FROM (SELECT *, trim(regexp_replace(lower({text}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS plain FROM source))"""


def _sql_near(a: str, b: str) -> str:
    m, n = f"((length({a}) + 1) / 9)", f"((length({b}) + 1) / 9)"
    common = f"len(list_intersect(string_split({a}, ','), string_split({b}, ',')))"
    return f"CASE WHEN {a} = {b} THEN 1.0::DOUBLE ELSE {common} / ({m} + {n} - {common}) END"


SQL = f"""
WITH own AS (
  WITH source AS (SELECT doc_id, coalesce(text, '') AS text FROM documents) {_sql_print("text")}
), linked AS (
  SELECT doc_id, text, print AS fingerprint, length(text) AS n_chars,
    coalesce(lead(text) OVER w, first_value(text) OVER w) AS next_text, coalesce(lead(print) OVER w, first_value(print) OVER w) AS next_print
  FROM own WINDOW w AS (ORDER BY doc_id DESC NULLS LAST, text DESC)
), edits AS (
  WITH source AS (
    SELECT doc_id, n_chars, fingerprint, next_print, substr(text, 1, n_chars - n_chars // 2) || substr(next_text, 1, n_chars // 2) AS edited FROM linked
  ) {_sql_print("edited")}
)
SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, fingerprint, print AS edited_fingerprint,
  {_sql_near("fingerprint", "print")} AS near_edited, {_sql_near("fingerprint", "next_print")} AS near_next,
  floor(ln((length(fingerprint) + 1) / 9) / ln(1 / 0.1::DOUBLE))::INT AS length_band
FROM edits
"""
