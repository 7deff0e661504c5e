"""Literal search: folded text, three-character grams, BM25 over the phrase, snippets.

A gram index (:func:`build_postings`, stored or built on the way) gives candidates: every query
looks up only its rarest gram, and the text check decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import constants as K
from ..functions.grams import gram_counts
from ..functions.identity import format_etag
from ..functions.snippets import snippet
from ..functions.unicode import fold
from ..session import spread, written_table


def indexed_notes(files: DataFrame) -> DataFrame:
    """Live inline Markdown with its folded text."""
    scope = ~F.col("deleted") & (F.col("kind") == "text") & (F.lower(F.right("path", F.lit(3))) == ".md")
    notes = spread(files.filter(scope).select("vault_id", "path", "rev", "content"))
    return notes.withColumn("folded", fold(F.col("content")))


def search_coverage(files: DataFrame) -> DataFrame:
    """Indexed notes and large notes outside the index, per vault."""
    md = ~F.col("deleted") & (F.lower(F.right("path", F.lit(3))) == ".md")
    return files.groupBy("vault_id").agg(
        F.count_if(md & (F.col("kind") == "text")).alias("indexed_files"),
        F.count_if(md & (F.col("kind") == "blob") & (F.col("size") > K.INLINE_TEXT_LIMIT)).alias("unindexed_large_files"),
    )


# A zero-width match at every character captures the three that follow; the first part
# skips the second half of a surrogate pair, so each character starts one gram.
_GRAM = "(?s)(?![\\uDC00-\\uDFFF])(?=(...))"


def grams(text: Column) -> Column:
    """Every three-character window of folded text, in order, in one linear pass."""
    return F.regexp_extract_all(text, F.lit(_GRAM), F.lit(1))


def build_postings(notes: DataFrame) -> DataFrame:
    """(vault_id, gram, path, tf). The texts of a path meet once and are counted where they are, so the postings,
    many times as many rows, are not shuffled to be added up."""
    texts = notes.repartition("vault_id", "path").groupBy("vault_id", "path").agg(F.collect_list("folded").alias("texts"))
    return texts.select("vault_id", "path", F.inline(gram_counts(F.col("texts")))).select(
        "vault_id", "gram", "path", F.col("tf").cast("long").alias("tf")
    )


def update_postings(postings: DataFrame, changed: DataFrame, files: DataFrame) -> DataFrame:
    """Postings after a batch: rows of changed paths are dropped and rebuilt from live notes."""
    keys = changed.select("vault_id", "path").distinct()
    rebuilt = build_postings(indexed_notes(files.join(keys, ["vault_id", "path"], "left_semi")))
    return postings.join(keys, ["vault_id", "path"], "left_anti").unionByName(rebuilt)


def phrase_count(text: Column, phrase: Column) -> Column:
    """Occurrences of a phrase, overlapping ones included (zero-width look-ahead)."""
    quoted = F.concat(F.lit("(?=\\Q"), F.replace(phrase, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E)"))
    return F.regexp_count(text, quoted).cast("long")


def valid_queries(queries: DataFrame) -> DataFrame:
    """Adds the folded phrase, the limit with its default and ``reason``."""
    length = F.char_length("query")
    limit = F.coalesce("result_limit", F.lit(K.SEARCH_DEFAULT)) if "result_limit" in queries.columns else F.lit(K.SEARCH_DEFAULT)
    return queries.withColumns({"phrase": fold(F.col("query")), "result_limit": limit}).withColumn(
        "reason",
        F.when(length < 3, "query_too_short").when(length > 200, "query_too_long")
        .when(~F.col("result_limit").between(1, K.SEARCH_MAX), "invalid_request"),
    )


def literal_match(queries: DataFrame, notes: DataFrame, postings: DataFrame | None = None) -> DataFrame:
    """Notes that contain a query's phrase: candidates from its rarest gram, verified against the text."""
    asked = queries.filter(F.col("reason").isNull()).select("vault_id", "query_id", "phrase", "result_limit")
    wanted = asked.select("vault_id", "query_id", F.explode(F.array_distinct(grams(F.col("phrase")))).alias("gram"))
    terms = wanted.select("vault_id", "gram").distinct()
    index = build_postings(notes) if postings is None else postings
    # Read twice below; written down once, the index is not built again for it.
    used = written_table(index.join(terms, ["vault_id", "gram"], "left_semi").select("vault_id", "gram", "path"), "asked-postings")
    frequency = used.groupBy("vault_id", "gram").agg(F.count(F.lit(1)).alias("notes"))
    rarest = (
        wanted.join(frequency, ["vault_id", "gram"], "left")
        .groupBy("vault_id", "query_id")
        .agg(F.min_by("gram", F.struct(F.coalesce("notes", F.lit(0)), "gram")).alias("gram"))
    )
    candidates = used.join(rarest, ["vault_id", "gram"]).select("vault_id", "query_id", "path")
    return (
        candidates.join(asked, ["vault_id", "query_id"])
        .join(notes.select("vault_id", "path", "rev", "folded"), ["vault_id", "path"])
        .filter(F.contains("folded", F.col("phrase")))
    )


def bm25_phrase(tf: Column, tokens: Column, notes: Column, matched: Column, mean_tokens: Column) -> Column:
    """Published BM25 of one phrase, negated so that lower is better."""
    idf = F.greatest(F.log((notes - matched + F.lit(0.5)) / (matched + F.lit(0.5))), F.lit(K.BM25_MIN_IDF))
    norm = F.lit(1 - K.BM25_B) + F.lit(K.BM25_B) * tokens / mean_tokens
    return -(idf * tf * F.lit(K.BM25_K1 + 1) / (tf + F.lit(K.BM25_K1) * norm))


def search_notes(queries: DataFrame, files: DataFrame, epoch: str, postings: DataFrame | None = None) -> DataFrame:
    """Ranked hits of every valid query: score ascending, then binary path order.

    Hits carry counts only; the texts of ranked rows are joined back for their snippets. Notes are folded once, and
    each text is compared with a phrase once: folded notes, hits and ranked rows are tables that later steps read.
    """
    tokens = F.greatest(F.char_length("folded") - 2, F.lit(0)).cast("long")
    notes = written_table(indexed_notes(files).withColumn("tokens", tokens), "search-notes")
    asked = valid_queries(queries)
    totals = notes.groupBy("vault_id").agg(F.count(F.lit(1)).alias("notes"), F.avg("tokens").alias("mean_tokens"))
    found = literal_match(asked, notes, postings).select(
        "vault_id", "query_id", "path", "rev", "phrase", "result_limit", tokens.alias("tokens"),
        phrase_count(F.col("folded"), F.col("phrase")).alias("tf"),
    )
    hits = written_table(found, "search-hits")
    matched = hits.groupBy("vault_id", "query_id").agg(F.count(F.lit(1)).alias("matched"))
    score = bm25_phrase(F.col("tf"), F.col("tokens"), F.col("notes"), F.col("matched"), F.col("mean_tokens"))
    scored = hits.join(matched, ["vault_id", "query_id"]).join(totals, "vault_id").withColumn("score", F.round(score, 6))
    best = Window.partitionBy("vault_id", "query_id").orderBy("score", "path")
    # The literal bound lets Spark keep only the best rows of each input partition before it shuffles.
    ranked = (
        scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= K.SEARCH_MAX).filter(F.col("rank") <= F.col("result_limit"))
        .select("vault_id", "query_id", "rank", "path", "rev", "score", "phrase")
    )
    texts = notes.select("vault_id", "path", "content", "folded")
    # A page of rows per query: as a table of known size it is joined where the texts are.
    return written_table(ranked, "search-ranked").join(texts, ["vault_id", "path"]).select(
        "vault_id", "query_id", "rank", "path", format_etag(F.lit(epoch), F.col("rev")).alias("etag"), "score",
        snippet(F.col("content"), F.col("folded"), F.col("phrase")).alias("snippet"),
    )
